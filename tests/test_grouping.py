"""Grouping decisions on literal pages, plus a brute-force scan over random documents."""

import random

import pytest

from pagewise import schemas
from pagewise.functions import values as V
from pagewise.operators import grouping as G


def page(number, doc_type, supplier=None, confidence=0.95, continuation=False, cnpj=None, doc_id=1):
    return (doc_id, number, doc_type, supplier, confidence, "rule", doc_type, continuation, cnpj)


def ranges(spark, pages):
    df = spark.createDataFrame(pages, schemas.CLASSIFIED)
    rows = G.group_pages(df).orderBy("doc_id", "group_seq").collect()
    return [(r.start_page, r.end_page, r.doc_type) for r in rows]


CASES = {
    "pix never merges": (
        [("pix_comprovante", "Maria Silva"), ("pix_comprovante", "Maria Silva")],
        [(1, 1, "pix_comprovante"), (2, 2, "pix_comprovante")],
    ),
    "different types": ([("pix_comprovante", "A"), ("darf", None)], [(1, 1, "pix_comprovante"), (2, 2, "darf")]),
    "two darfs": ([("darf", None), ("darf", None)], [(1, 1, "darf"), (2, 2, "darf")]),
    "satellite bundle": (
        [("viasat_fatura", "Viasat"), ("viasat_fatura", "Viasat"), ("nfe", "Viasat Brasil"), ("cupom_fiscal", "M")],
        [(1, 3, "viasat_fatura"), (4, 4, "cupom_fiscal")],
    ),
    "unrelated invoice": (
        [("viasat_fatura", "Viasat"), ("nfe", "Viasat"), ("nfe", "Oeste Representacoes")],
        [(1, 2, "viasat_fatura"), (3, 3, "nfe")],
    ),
    "receipt bundle": (
        [("comprovante_pagamento", "M"), ("recibo_pagador", "P"), ("nfe", "P"), ("pix_comprovante", "Paulo")],
        [(1, 3, "nfe"), (4, 4, "pix_comprovante")],
    ),
    "boleto bundle": (
        [("comprovante_pagamento", "P"), ("boleto_outros_bancos", "P"), ("nfe", "P")],
        [(1, 3, "boleto_outros_bancos")],
    ),
    "no invoice in sight": (
        [("comprovante_pagamento", "Oeste"), ("recibo_pagador", "Oeste R"), ("comprovante_pagamento", "Pm")],
        [(1, 1, "comprovante_pagamento"), (2, 2, "recibo_pagador"), (3, 3, "comprovante_pagamento")],
    ),
    "energy": (
        [("comprovante_pagamento", "Coelba"), ("conta_energia", "Neoenergia"), ("conta_energia", "Neoenergia")],
        [(1, 1, "comprovante_pagamento"), (2, 3, "conta_energia")],
    ),
    "municipal tax": (
        [("comprovante_pagamento", "Pm"), ("imposto_municipal", "Maceio"), ("imposto_municipal", "Maceio")],
        [(1, 1, "comprovante_pagamento"), (2, 3, "imposto_municipal")],
    ),
    "fgts": ([("fgts_guia", None), ("fgts_detalhe", None)], [(1, 1, "fgts_guia"), (2, 2, "fgts_detalhe")]),
}


def test_literal_cases(spark):
    """All cases in one job, one document each."""
    pages = [
        page(i, kind, supplier, doc_id=doc)
        for doc, (given, _) in enumerate(CASES.values())
        for i, (kind, supplier) in enumerate(given, 1)
    ]
    found: dict[int, list] = {}
    groups = G.group_pages(spark.createDataFrame(pages, schemas.CLASSIFIED))
    for r in groups.orderBy("doc_id", "group_seq").collect():
        found.setdefault(r.doc_id, []).append((r.start_page, r.end_page, r.doc_type))
    for doc, (name, (_, expected)) in enumerate(CASES.items()):
        assert found[doc] == expected, name


def test_continuation_attaches_unknown(spark):
    pages = [page(1, "boleto_outros_bancos", "Honda"), page(2, V.UNKNOWN, None, 0.0, True)]
    assert ranges(spark, pages) == [(1, 2, "boleto_outros_bancos")]
    df = spark.createDataFrame(pages, schemas.CLASSIFIED)
    assert [r.attaches for r in G.should_group_pairwise(df).collect()] == [True]


BATCH = """planilha_movimento_caixa|
viasat_fatura|Viasat
viasat_fatura|Viasat
viasat_fatura|Viasat
nfe|Viasat
cupom_fiscal|Mercado Divino
pix_comprovante|Agromaquinas
boleto_outros_bancos|Honda
+|
pix_comprovante|Artur
pix_qrcode_comprovante|Joao Marcos
pix_comprovante|Joao Guedes
pix_comprovante|Geneci
folha_pagamento|
pix_comprovante|Gilvan
nfe|GP do Nascimento
comprovante_pagamento|Coelba
conta_energia|Neoenergia
conta_energia|Neoenergia
folha_pagamento|
boleto_outros_bancos|Honda
+|
darf|
darf|
relacao_bases_inss|
pix_qrcode_comprovante|CEF
fgts_guia|
fgts_detalhe|
boleto_outros_bancos|Honda
+|
comprovante_pagamento|Oeste
recibo_pagador|Oeste
comprovante_pagamento|Pm Maceio
imposto_municipal|Maceio
imposto_municipal|Maceio
nfe|Agromaquinas
comprovante_pagamento|Sefaz
ipva|
comprovante_pagamento|Premix
recibo_pagador|Premix
nfe|Premix
pix_comprovante|Paulo
viasat_fatura|Viasat
viasat_fatura|Viasat
nfe|Viasat
nfe|Oeste"""


def test_whole_batch(spark):
    pages = []
    for number, line in enumerate(BATCH.splitlines(), 1):
        kind, supplier = line.split("|")
        pages.append(
            page(number, V.UNKNOWN, continuation=True) if kind == "+" else page(number, kind, supplier or None)
        )
    found = ranges(spark, pages)
    assert len(pages) == 46 and len(found) == 34
    assert sum(end - start + 1 for start, end, _ in found) == 46
    assert found[1][:2] == (2, 5) and found[30][:2] == (39, 41)


# ---- brute force: the same rules as a plain left-to-right scan ----


def satellite(p):
    return p["t"] == "viasat_fatura" or "viasat" in f"{p['s'] or ''} {p['m'] or ''}".lower()


def compatible(a, b):
    if a["n"] and b["n"] and a["n"][:8] == b["n"][:8]:
        return True
    x, y = (" ".join((z["s"] or "").lower().split()) for z in (a, b))
    return not x or not y or x in y or y in x


def joins(group, cur, nxt):
    prev = group[-1]
    bill = (
        prev["t"] in V.TWO_SIDED_BILLS
        and (cur["t"] == prev["t"] or (cur["t"] == V.UNKNOWN and cur["c"] < 0.5))
        and (cur["t"] == V.UNKNOWN or compatible(cur, prev))
    )
    if cur["k"] or bill:
        return True
    if {cur["t"], prev["t"]} & set(V.SINGLETON_TYPES):
        return False
    types = {p["t"] for p in group}
    if satellite(cur) or any(map(satellite, group)):
        return satellite(cur) or (cur["t"] == "nfe" and "nfe" not in types)
    if cur["t"] == prev["t"] and cur["t"] in V.MULTIPAGE_TYPES and compatible(cur, prev):
        return True
    if cur["t"] == "nfe" and types & set(V.BOLETO_CHAIN_TYPES):
        return True
    after_receipt = cur["t"] in ("boleto_outros_bancos", "recibo_pagador") and prev["t"] == "comprovante_pagamento"
    return bool(after_receipt and nxt and nxt["t"] == "nfe")


def scan(pages):
    sequence, group, numbers = [], [], 0
    for i, cur in enumerate(pages):
        if group and joins(group, cur, pages[i + 1] if i + 1 < len(pages) else None):
            group.append(cur)
        else:
            group, numbers = [cur], numbers + 1
        sequence.append(numbers)
    return sequence


@pytest.mark.parametrize("bits, span_bits", [(2, 1), (2, 10), (12, 10)])
def test_random_documents_match_the_scan(spark, bits, span_bits):
    rng = random.Random(7)
    kinds = ["viasat_fatura", "nfe", "nfe", "comprovante_pagamento", "boleto_outros_bancos", "recibo_pagador",
             "conta_energia", "imposto_municipal", "darf", "pix_comprovante", V.UNKNOWN, "fgts_guia", "ipva"]
    rows, expected = [], {}
    for doc in range(150):
        pages = []
        for _ in range(rng.choice([1, 2, 5, 17, 40, 64])):
            kind = rng.choice(kinds[: rng.choice([4, 8, 13])])
            pages.append({
                "t": kind, "s": rng.choice([None, "Viasat", "Premix", "premix  ltda", ""]), "c": rng.choice([0.0, 0.6, 0.95]),
                "m": kind if rng.random() < 0.9 else "viasat", "k": rng.random() < 0.05,
                "n": rng.choice([None, "14796606000190", "14796606000270", "11222333000181"]),
            })
        expected[doc] = scan(pages)
        rows += [(doc, i, p["t"], p["s"], p["c"], "rule", p["m"], p["k"], p["n"]) for i, p in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, schemas.CLASSIFIED)
    got = {}
    for r in G.assign_groups(df, bits, span_bits).orderBy("doc_id", "page_number").collect():
        got.setdefault(r.doc_id, []).append(r.group_seq)
    assert got == expected


def test_coverage(spark):
    def check(groups, total):
        g = spark.createDataFrame([(1, i, "x", None, a, b, False) for i, (a, b) in enumerate(groups, 1)], schemas.GROUPS)
        d = spark.createDataFrame([(1, total), (2, 1)], "doc_id BIGINT, total_pages INT")
        rows = G.coverage_check(g, d).filter("doc_id = 1").collect()
        return sorted((r.violation, r.page_number) for r in rows)

    assert check([(1, 2), (3, 5)], 5) == []
    assert check([(1, 2), (4, 5)], 5) == [("missing", 3)]
    assert check([(1, 3), (3, 6), (9, 8)], 5) == [("extra", 6), ("inverted", 9), ("overlap", 3)]
