"""Rule dictionary, type sets, labels, packages and limits.

Everything in this module is a literal the results depend on, kept as plain text in its natural
order. No logic lives here.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One dictionary entry: any pattern found on the page proposes ``doc_type``."""

    doc_type: str
    patterns: tuple[str, ...]
    supplier_pattern: str | None = None
    confidence: float = 0.9
    is_regex: bool = False


UNKNOWN = "desconhecido"
CONFIDENCE_THRESHOLD = 0.8
MIN_NATIVE_TEXT_LENGTH = 50

# ---- fixed values: the shipped rule dictionary (17 rules, 65 patterns) ----
_PIX_PAYEE = (
    r"(?:nome do (?:benefici[aáà]rio|favorecido)|nome favorecido|favorecido)"
    r"\s*:?\s*(.+?)(?:\n|cpf|cnpj|chave|institui|$)"
)

SHIPPED_RULES: tuple[Rule, ...] = (
    Rule("planilha_movimento_caixa", ("movimento de caixa", "entrada/saida", "movimento diario"), None, 0.9),
    Rule(
        "pix_comprovante",
        (
            "comprovante de transferencia",
            "pix por chave",
            "pix por dados da conta",
            "transferencia pix",
            "pix realizado",
        ),
        _PIX_PAYEE,
        0.95,
    ),
    Rule(
        "pix_qrcode_comprovante",
        ("qr code pix", "qrcode pix", "pagamento via qr code", "qr code pix"),
        _PIX_PAYEE,
        0.95,
    ),
    Rule(
        "boleto_outros_bancos",
        ("comprovante de pagamento outros bancos", "pagamento de boleto", "pagamento outros bancos"),
        r"(?:benefici[aáà]rio|favorecido|razao social do benefici[aáà]rio)\s*:?\s*(.+?)(?:\n|cpf|cnpj|$)",
        0.9,
    ),
    Rule(
        "recibo_pagador",
        ("recibo do pagador", "recibo de pagador", "comprovante de beneficiario"),
        r"(?:benefici[aáà]rio|cedente)\s*:?\s*(.+?)(?:\n|cnpj|cpf|$)",
        0.9,
    ),
    Rule("darf", ("darf", "receita federal", "secretaria da receita federal"), None, 0.95),
    Rule("fgts_detalhe", ("detalhe da guia", "detalhe da guia emitida", "relacao de trabalhadores"), None, 0.95),
    Rule("fgts_guia", ("gfd", "guia do fgts digital", "fgts digital", "guia de recolhimento do fgts"), None, 0.95),
    Rule("relacao_bases_inss", ("relacao de bases do inss", "relacao de bases", "bases do inss"), None, 0.95),
    Rule(
        "folha_pagamento",
        ("extrato mensal", "folha mensal", "folha de pagamento", "demonstrativo de pagamento"),
        None,
        0.9,
    ),
    Rule(
        "nfe",
        ("nf-e", "danfe", "documento auxiliar da nota fiscal", "nota fiscal eletronica"),
        r"(?:razao social|nome/razao social)\s*:?\s*(.+?)(?:\n|cnpj|$)",
        0.95,
    ),
    Rule(
        "conta_energia",
        ("neoenergia", "coelba", "energia eletrica", "conta de energia", "aneel"),
        r"(neoenergia|coelba|celpe|cosern)",
        0.95,
    ),
    Rule(
        "viasat_fatura",
        ("viasat", "viasat brasil"),
        r"(viasat(?: brasil)?(?: servicos de comunica[cç]oes?)?)",
        0.95,
    ),
    Rule(
        "imposto_municipal",
        (
            "prefeitura de",
            "prefeitura de maceio",
            "duam",
            "guia dam",
            "documento unico de arrecadacao municipal",
            "taxa de funcion",
            "issqn",
        ),
        r"prefeitura (?:municipal )?de (.+?)(?:\n|$)",
        0.92,
    ),
    Rule("ipva", ("ipva parcelado", "ipva", "dar/cb", "dar / cb"), None, 0.96),
    Rule(
        "cupom_fiscal",
        ("transacao aprovada", "cupom controle", "cupom fiscal"),
        r"(mercado .+?)(?:\n|cnpj|$)",
        0.85,
    ),
    Rule(
        "comprovante_pagamento",
        (
            "pagamento realizado",
            "valor pago via boleto",
            "comprovante de pagamento titulos",
            "identificacao no extrato",
            "comprovante de pagamento",
        ),
        r"(?:nome do benefici[aáà]rio|razao social do benefici[aáà]rio|valor pago via boleto para)"
        r"\s*:?\s*(.+?)(?:\n|cpf|cnpj|$)",
        0.8,
    ),
)

# ---- fixed values: text patterns ----
CNPJ_PATTERN = r"(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})"
PAGE_MARKER_PATTERNS = (
    r"(?:pagina|folha|pag\.?)\s*(\d+)\s*(?:de|/)\s*(\d+)",
    r"\b(\d{1,2})\s*de\s*(\d{1,2})\b",
    r"\b(\d{1,2})de(\d{1,2})\b",
)
MAX_PAGE_MARKER = 8
CONTINUATION_WORD = "continuacao"
SPREADSHEET_MIN_LENGTH = 400
SPREADSHEET_MIN_TOKENS = 40
SPREADSHEET_SHORT_SHARE = 0.55
SPREADSHEET_TYPE = "planilha_movimento_caixa"
SPREADSHEET_CONFIDENCE = 0.6
SPREADSHEET_PATTERN = "heuristica_planilha"
SATELLITE_WORD = "viasat"
SATELLITE_TYPE = "viasat_fatura"
SATELLITE_SUPPLIER = "Viasat"
SATELLITE_CONFIDENCE = 0.9
SATELLITE_SOURCES = ("comprovante_pagamento", "boleto_outros_bancos", "desconhecido")
EXCERPT_LENGTH = 6000
NO_PREVIOUS = "nenhum"

# ---- fixed values: document type sets used for grouping ----
PIX_TYPES = ("pix_comprovante", "pix_qrcode_comprovante")
SINGLETON_TYPES = PIX_TYPES + (
    "planilha_movimento_caixa",
    "folha_pagamento",
    "relacao_bases_inss",
    "darf",
    "fgts_detalhe",
    "cupom_fiscal",
)
MULTIPAGE_TYPES = (
    "viasat_fatura",
    "conta_energia",
    "nfe",
    "imposto_municipal",
    "boleto_outros_bancos",
    "fgts_guia",
)
BOLETO_CHAIN_TYPES = ("comprovante_pagamento", "boleto_outros_bancos", "recibo_pagador")
TWO_SIDED_BILLS = ("conta_energia", "imposto_municipal")
TYPE_PRIORITY = (
    "viasat_fatura",
    "boleto_outros_bancos",
    "nfe",
    "conta_energia",
    "imposto_municipal",
    "ipva",
    "fgts_guia",
    "recibo_pagador",
    "comprovante_pagamento",
    "darf",
    "pix_comprovante",
    "pix_qrcode_comprovante",
)

# ---- fixed values: readable labels ----
DOC_TYPE_LABELS = {
    "pix_comprovante": "Comprovante PIX",
    "pix_qrcode_comprovante": "Comprovante PIX (QR Code)",
    "boleto_outros_bancos": "Boleto (Outros Bancos)",
    "recibo_pagador": "Recibo do Pagador",
    "comprovante_pagamento": "Comprovante de Pagamento",
    "cupom_fiscal": "Cupom / Comprovante de Cartão",
    "darf": "DARF (Receita Federal)",
    "fgts_guia": "Guia FGTS",
    "fgts_detalhe": "Detalhe da Guia FGTS",
    "folha_pagamento": "Folha de Pagamento",
    "relacao_bases_inss": "Relação de Bases do INSS",
    "nfe": "Nota Fiscal Eletrônica (NF-e)",
    "conta_energia": "Conta de Energia",
    "viasat_fatura": "Fatura Viasat",
    "imposto_municipal": "Imposto Municipal",
    "ipva": "IPVA",
    "planilha_movimento_caixa": "Planilha - Movimento de Caixa",
    "desconhecido": "Documento Não Classificado",
}
INDEX_COLUMNS = (
    "Número",
    "Arquivo",
    "Tipo de Documento",
    "Fornecedor/Beneficiário",
    "Páginas Originais",
    "Total de Páginas",
    "Precisa Revisão",
)

# ---- fixed values: credit packages (id, price, MB, label) ----
CREDIT_PACKAGES = (
    ("basic", 5, 50, "Básico"),
    ("plus", 15, 200, "Plus (Bônus 33%)"),
    ("pro", 30, 500, "Pro (Bônus 67%)"),
    ("premium", 50, 1000, "Premium (Bônus 100%)"),
)
CREDITS_PER_BRL = 10
CREDIT_VALID_DAYS = 90
DEFAULT_METHOD = "mercadopago"
EXTERNAL_REFERENCE_PATTERN = r"^user_([0-9a-fA-F-]{36})_pkg_(basic|plus|pro|premium)$"

# ---- fixed values: limits ----
UPLOAD_LIMITS = (
    # environment, largest upload in MB, most pages
    ("vercel", 4, 20),
    ("railway", 50, 200),
    ("production", 100, 500),
)
MAX_FREE_USES_DAY = 1
MAX_FREE_FILE_SIZE_MB = 2
MAX_FREE_PAGES = 10
TOOL_LIMIT_DAY = 2
LOCAL_ADDRESSES = ("unknown", "127.0.0.1", "::1", "localhost")
PRIVATE_PREFIXES = ("10.", "192.168.", "fc", "fd")

# ---- fixed values: refunds ----
FEE_DEDUCT_METHODS = (
    "credit_card",
    "debit_card",
    "ticket",
    "visa",
    "master",
    "elo",
    "amex",
    "hipercard",
    "bolbradesco",
    "pec",
)
FEE_DEDUCT_TYPES = ("credit_card", "debit_card", "ticket")
FEE_DEDUCT_WORDS = ("credit", "debit", "boleto")
INVOICE_PREFIX = "invoice_"
PREVIEW_INVOICE_METHODS = ("invoice", "manual", "faturado")
REASON_NOT_APPROVED = "Pagamento não está aprovado."
REASON_ALREADY_REFUNDED = "Transação já reembolsada."
REASON_NO_CREDITS = "Sem créditos disponíveis na conta para estornar (pacote já usado)."
REASON_NO_MONEY = "Valor reembolsável zerado."
REASON_PROVIDER_STATUS = "Status no Mercado Pago: "

# ---- fixed values: accented letters a post slug maps by hand ----
SLUG_ACCENTS_FROM = "áàãâéêíóôõúç"
SLUG_ACCENTS_TO = "aaaaeeiooouc"
