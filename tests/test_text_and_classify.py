"""Literal page texts and their expected classification."""

import pytest
from pyspark.sql import functions as F

from pagewise import schemas
from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.functions.values import Rule
from pagewise.operators import classify as C
from pagewise.operators import grouping as G
from pagewise.operators import naming as N

BANK = (
    "Identificacao no extrato PAG TIT BANCO 033 Nome do beneficiario Viasat Brasil Servicos de Comunicacoes "
    "valor pago R$ 309,00"
)
PAGES = {
    "PREFEITURA DE MACEIO DOCUMENTO DE ARRECADACAO GUIA DAM TAXA DE FUNCIONAMENTO": ("imposto_municipal", None),
    "GOVERNO DO ESTADO DE ALAGOAS IPVA Parcelado DAR / CB DOCUMENTO DE ARRECADACAO": ("ipva", None),
    "Comprovante de transferencia Pix por chave nome do favorecido JOAO DA SILVA GUEDES": ("pix_comprovante", "JOAO"),
    "\n    Comprovante de Transferência PIX\n    Nome do beneficiário: MARIA DA SILVA\n    CPF: 123.456.789-00\n": ("pix_comprovante", "MARIA"),
    "DANFE Documento Auxiliar da Nota Fiscal Eletrônica NF-e Razão Social: PREMIX LTDA": ("nfe", None),
    BANK: ("viasat_fatura", "Viasat"),
    "Calculo: Folha Mensal Competencia 07/2025 RELACAO DE BASES DO INSS Codigo Nome do empregado": ("relacao_bases_inss", None),
    "nada que se conheça": (V.UNKNOWN, None),
    " ".join(["ej", "a", "5", "|"] * 120): ("planilha_movimento_caixa", None),
}


def pages_of(spark, texts, doc_id=1):
    return spark.createDataFrame([(doc_id, i, t, None) for i, t in enumerate(texts, 1)], schemas.PAGES)


def test_literal_pages(spark):
    rows = C.classify_pages(pages_of(spark, PAGES)).orderBy("page_number").collect()
    for row, (kind, name) in zip(rows, PAGES.values(), strict=True):
        assert row.doc_type == kind
        assert name is None or name.upper() in row.supplier.upper()
    assert rows[-1].matched_pattern == V.SPREADSHEET_PATTERN and rows[-1].confidence == 0.6


def values_of(spark, texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("São José", "sao jose"),
        ("  A\tB\x0b\x1cC  D ", "a b c d"),
        ("ﬁm… ½ ª 5º ² Ｆ＇", "fim... 12 a 5o 2 f'"),
        ("日本", ""),
        ("Décembre", "decembre"),
    ],
)
def test_normalize(spark, text, expected):
    assert values_of(spark, [text], v=T.normalize_text(F.col("t")))[0].v == expected


def test_markers_and_continuation(spark):
    texts = [
        "2de2 Data do pagamento: 05/08/2025", "Página 2 de 2 autenticacao", "1 de 2 comprovante de pagamento outros bancos",
        "Pagamento em 05/08/2025 valor 100", "Continuação do anexo", "15 de 20 e 3de4", "folha 9/12", "pag. 99999999999999999999 de 3",
    ]
    rows = values_of(spark, texts, c=T.is_continuation(T.normalize_text(F.col("t"))), m=T.page_x_of_y(T.normalize_text(F.col("t"))))
    assert [r.c for r in rows] == [True, True, False, False, True, True, False, False]
    assert (rows[5].m.current, rows[5].m.total) == (3, 4)


def test_scalars(spark):
    row = values_of(
        spark, ["CNPJ 00.000.000/0000-00 e 14.796.606/0001-90 Viasat"],
        cnpj=T.extract_cnpj(F.col("t")), base=T.cnpj_base(F.lit("14.796.606/0001-90")), short=T.cnpj_base(F.lit("12.3")),
        slug=T.slugify(F.lit("Energia Elétrica - Conta")), empty=T.slugify(F.lit("!!")), label=T.doc_type_label(F.lit("d'agua_2via")),
        long=T.clean_supplier(F.lit("Primeira palavra " + "x" * 50 + " fim")), tiny=T.clean_supplier(F.lit(" -a. ")),
        post=T.blog_slug(F.lit(" Olá, Mundo__novo — já! "), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")),
        none=T.blog_slug(F.lit("***"), F.lit("1970-01-02 00:00:00").cast("timestamp_ntz")),
        broken=T.extract_supplier(F.col("t"), "(["), groupless=T.extract_supplier(F.col("t"), "Viasat"),
    )[0]
    assert row.cnpj == "14796606000190" and row.base == "14796606" and row.short is None
    assert row.slug == "energia_eletrica_conta" and row.empty == V.UNKNOWN and row.label == "D'Agua 2Via"
    assert row.long == "Primeira palavra" and row.tiny is None
    assert row.post == "ola-mundonovo-ja" and row.none == "post-86400"
    assert row.broken is None and row.groupless is None


def test_user_rules(spark):
    table = spark.createDataFrame(
        [(0, "recibo", ["recibo n[ºo]? ?[0-9]+"], None, 0.7, True), (1, "recibo_b", ["recibo no 77"], None, 0.7, False)], schemas.RULES
    )
    rules = C.rules_from_table(table)
    assert rules[0] == Rule("recibo", ("recibo n[ºo]? ?[0-9]+",), None, 0.7, True)
    row = C.classify_pages(pages_of(spark, ["RECIBO Nº 77"]), rules).first()
    assert (row.doc_type, row.confidence) == ("recibo", 0.7)


def test_fallback(spark):
    bodies = [
        '```json\n{"doc_type":"nfe","supplier":" X ","confidence":1.4,"is_continuation":"false","reasoning":"abc"}\n```',
        "nada", '{"confidence":null}', '{"doc_type":null,"is_continuation":true}', "[1]", '{"doc_type":"darf","confidence":"0.9","is_continuation":0}',
    ]
    answers = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies, 1)], schemas.RESPONSES)
    parsed = [tuple(r)[2:7] + (r.is_continuation,) for r in C.parse_responses(answers).orderBy("page_number").collect()]
    unknown = (V.UNKNOWN, None, 0.0, "llm", None, False)
    assert parsed == [
        ("nfe", "X", 1.0, "llm", "abc", True), unknown, unknown, (V.UNKNOWN, None, 0.0, "llm", None, True), unknown,
        ("darf", None, 0.9, "llm", None, False),
    ]
    texts = ["sem regra", "sem regra", "sem regra", "sem regra", "sem regra", "cupom fiscal"]
    merged = C.classify_pages(pages_of(spark, texts), responses=C.parse_responses(answers), threshold=0.88).orderBy("page_number").collect()
    assert [(r.doc_type, r.source) for r in merged] == [
        ("nfe", "llm"), (V.UNKNOWN, "llm"), (V.UNKNOWN, "llm"), (V.UNKNOWN, "llm"), (V.UNKNOWN, "llm"), ("darf", "llm")
    ]


def test_request_keeps_the_space_its_excerpt_ends_on(spark):
    texts = ["  " + "ab " * 2500, "\t" + "a" * (V.EXCERPT_LENGTH - 1) + "\u00a0b", " curto "]
    rows = C.fallback_requests(pages_of(spark, texts)).orderBy("page_number").collect()
    for row, text in zip(rows, texts, strict=True):
        assert row.request.split('"""')[1] == "\n" + text.strip()[: V.EXCERPT_LENGTH] + "\n"


def test_mixed_file_end_to_end(spark):
    texts = [
        "MOVIMENTO DE CAIXA\nEntrada/Saída do mês de julho",
        "Comprovante de Transferência\nPIX por chave\nNome do beneficiário: MARIA DA SILVA\nValor: R$ 1.500,00",
        "Comprovante de Pagamento Outros Bancos\nBeneficiário: VIVO S.A.\nPágina 1 de 2\nValor: R$ 289,90",
        "Comprovante de Pagamento Outros Bancos\nBeneficiário: VIVO S.A.\nPágina 2 de 2\nAutenticação mecânica",
        "DARF\nDocumento de Arrecadação\nReceita Federal\nCódigo: 0220\nValor: R$ 3.412,55",
    ]
    named = N.filenames(G.group_pages(C.classify_pages(pages_of(spark, texts)))).orderBy("group_seq").collect()
    assert [r.filename for r in named] == [
        "01_planilha_movimento_caixa.pdf", "02_pix_comprovante_maria_da_silva.pdf", "03_boleto_outros_bancos_vivo_s_a.pdf", "04_darf.pdf",
    ]
    assert [(r.start_page, r.end_page) for r in named] == [(1, 1), (2, 2), (3, 4), (5, 5)]


def test_copies_and_wide_numbers(spark):
    groups = spark.createDataFrame([(1, i, "darf", None if i % 2 else "A", i, i, False) for i in range(1, 124)], schemas.GROUPS)
    names = {r.group_seq: r.filename for r in N.filenames(groups).collect()}
    assert names[1] == "01_darf.pdf" and names[3] == "03_darf_via2.pdf" and names[2] == "02_darf_a.pdf"
    assert names[123] == "123_darf_via62.pdf" and len(set(names.values())) == 123
