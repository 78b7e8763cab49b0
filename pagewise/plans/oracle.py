"""Reference SQL for the named queries, written for another SQL engine over the same files.

It is stated relationally and independently of the DataFrame code: ranked joins instead of ordered
``CASE``, recursive walks instead of folds.
"""

from __future__ import annotations

from pagewise.functions import text as T
from pagewise.functions import values as V
from pagewise.sources.tables import SAMPLE_RULES

LEDGER_AS_OF = "timestamp '2001-06-15 00:00:00'"
USAGE_AS_OF = "timestamp '2024-01-30 12:00:00'"

# ---- text snippets ----

SP = T._SPACES.replace("'", "''")
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def text_in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def strip(x: str) -> str:
    return f"trim({x}, '{SP}')"


def fold(x: str) -> str:
    spelled = f"translate({x}, '{_quoted(T.FOLD_FROM)}', '{_quoted(T.FOLD_TO)}')"
    for char, residue in T.FOLD_SEVERAL:
        spelled = f"replace({spelled}, '{char}', '{residue}')"
    return f"regexp_replace({spelled}, '[^\\x00-\\x7F]+', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({fold(f'lower({x})')}, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))"


def supplier(x: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return (
        f"nullif(trim(regexp_replace({strip(f"regexp_extract({x}, '(?ims){pattern}', 1)")}, '{WS}+', ' ', 'g'), ' :-'), '')"
    )


def cleaned(x: str) -> str:
    name = f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' :-.,')"
    cut = f"case when length({name}) > 60 then regexp_replace(substr({name}, 1, 60), ' [^ ]*$', '') else {name} end"
    return f"case when length({cut}) >= 3 then {cut} end"


def slug(x: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace({fold(f'lower({x})')}, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), '{V.UNKNOWN}')"
    )


def blog_slug(x: str, ts: str) -> str:
    kept = (
        f"regexp_replace(translate(lower({strip(x)}), '{V.SLUG_ACCENTS_FROM}', '{V.SLUG_ACCENTS_TO}'), "
        f"'[^a-z0-9{WS[1:-1]}-]', '', 'g')"
    )
    joined = f"trim(regexp_replace({kept}, '[{WS[1:-1]}_-]+', '-', 'g'), '-')"
    return f"coalesce(nullif(substr({joined}, 1, 80), ''), 'post-' || cast(cast(epoch({ts}) as bigint) as varchar))"


def cnpj(x: str) -> str:
    hits = f"list_transform(regexp_extract_all({x}, '{V.CNPJ_PATTERN}', 1), lambda h: regexp_replace(h, '\\D', '', 'g'))"
    return f"list_filter({hits}, lambda d: d <> repeat('0', 14))[1]"


def sheet(x: str) -> str:
    tokens = f"string_split_regex({strip(x)}, '{WS}+')"
    return (
        f"(length({x}) >= 400 and len({tokens}) >= 40 and "
        f"len(list_filter({tokens}, lambda t: length(t) <= 2)) * 1.0 / len({tokens}) > 0.55)"
    )


def root(x: str) -> str:
    return f"case when length(regexp_replace({x}, '\\D', '', 'g')) >= 8 then substr(regexp_replace({x}, '\\D', '', 'g'), 1, 8) end"


def squeezed(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g')), '')"


def compatible(s1: str, c1: str, s2: str, c2: str) -> str:
    a, b = squeezed(s1), squeezed(s2)
    return (
        f"(coalesce({root(c1)} = {root(c2)}, false) or coalesce(contains({a}, {b}) or contains({b}, {a}), true))"
    )


def label(x: str) -> str:
    known = " ".join(f"when '{k}' then '{v}'" for k, v in V.DOC_TYPE_LABELS.items())
    runs = f"regexp_extract_all(replace({x}, '_', ' '), '\\p{{L}}+|[^\\p{{L}}]+')"
    titled = f"array_to_string(list_transform({runs}, lambda r: upper(r[1:1]) || lower(r[2:])), '')"
    return f"case {x} {known} else {titled} end"


def marker(x: str, i: int) -> str:
    p = V.PAGE_MARKER_PATTERNS[i]
    cur, tot = (f"try_cast(regexp_extract({x}, '{p}', {g}) as integer)" for g in (1, 2))
    return f"case when {cur} >= 1 and {cur} <= {tot} and {tot} <= 8 then {{'c': {cur}, 't': {tot}}} end"


def markers(x: str) -> str:
    return f"coalesce({', '.join(marker(x, i) for i in range(3))})"


def usable(x: str) -> str:
    v = f"lower({strip(x)})"
    private = " or ".join(f"starts_with({v}, '{p}')" for p in V.PRIVATE_PREFIXES)
    return f"case when not ({v} = '' or {v} in {text_in(V.LOCAL_ADDRESSES)} or {private}) then {v} end"


def invoice(method: str, pid: str) -> str:
    return f"(lower(coalesce({method}, '')) = 'invoice' or starts_with(coalesce({pid}, ''), 'invoice_'))"


def deducts(method: str, kind: str) -> str:
    m = f"lower(coalesce({method}, ''))"
    words = " or ".join(f"contains({m}, '{w}')" for w in V.FEE_DEDUCT_WORDS)
    return f"({m} in {text_in(V.FEE_DEDUCT_METHODS)} or lower(coalesce({kind}, '')) in {text_in(V.FEE_DEDUCT_TYPES)} or {words})"


def counter(count: str, last: str) -> str:
    return f"case when {last} is not null and cast({last} as date) <> date '2024-01-30' then 0 else {count} end"


_USE_ADDRESS = "(case when e.event_id % 17 = 0 then '10.0.0.' else '200.10.0.' end || (e.user_id % 50))"


def _rules_values(rules, normalised: bool = True) -> str:
    rows = []
    for i, rule in enumerate(rules):
        for j, pattern in enumerate(rule.patterns):
            rows.append(f"({i}, {j}, '{rule.doc_type}', '{pattern}', cast({rule.confidence} as double), {len(pattern)})")
    return "values " + ", ".join(rows)


_SUPPLIER_CASE = "case rule_type " + " ".join(
    f"when '{r.doc_type}' then {cleaned(f'coalesce({supplier('text', r.supplier_pattern)}, {supplier('norm', r.supplier_pattern)})')}"
    for r in SAMPLE_RULES
    if r.supplier_pattern
) + " end"

CENT = "decimal(10,2)"


def refund_share(claw: str) -> str:
    """Cents of ``max_money * claw / credits_mb``, halves up, in whole numbers."""
    return (
        f"cast((cast(max_money * 100 as bigint) * {claw} * 2 + credits_mb) // (2 * credits_mb) as bigint) * cast(0.01 as decimal(3,2))"
    )


def cents(x: str) -> str:
    return f"cast(cast(floor({x}) as bigint) * cast(0.01 as decimal(3,2)) as {CENT})"


# ---- shared views: name -> SQL; each may use the ones before it ----

VIEWS: dict[str, str] = {
    "lines": "select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as i "
    "from (select doc_id, string_split(text, chr(10)) as parts from documents)",
    "corpus0": f"select doc_id, cast(i as integer) as page_number, nullif({strip('line')}, '') as native_text from lines",
    "corpus": "select *, case when coalesce(length(native_text), 0) < 50 and page_number % 3 = 0 "
    "then 'verso ' || native_text end as ocr_text from corpus0",
    "texts0": "select *, coalesce(nullif(ocr_text, ''), nullif(native_text, ''), '') as text from corpus",
    "texts": f"select *, {norm('text')} as norm from texts0",
    "rules": f"select * from ({_rules_values(SAMPLE_RULES)}) r(rule_ord, pattern_ord, doc_type, pattern, confidence, plen)",
    "matches": "select t.doc_id, t.page_number, r.* from texts t join rules r on contains(t.norm, r.pattern)",
    "winners": "select * from matches qualify row_number() over (partition by doc_id, page_number "
    "order by confidence desc, plen desc, rule_ord, pattern_ord) = 1",
    "signals0": "select t.*, w.doc_type as rule_type, w.confidence as rule_conf, w.pattern as rule_pattern "
    "from texts t left join winners w using (doc_id, page_number)",
    "signals": f"select *, {_SUPPLIER_CASE} as rule_supplier, "
    f"contains(norm, 'continuacao') or coalesce({markers('norm')}.c >= 2, false) as text_cont, "
    f"{cnpj('text')} as text_cnpj, contains(norm, 'viasat') as text_sat from signals0",
    "raw_result": "select doc_id, page_number, text, norm, text_cont, text_cnpj, text_sat, coalesce(rule_type, 'desconhecido') as doc_type, rule_supplier as supplier, "
    "coalesce(rule_conf, 0.0) as confidence, 'rule' as source, rule_pattern as matched_pattern, false as cont0, cast(null as varchar) as cnpj0 from signals",
}


def enriched(source: str) -> str:
    """The enrichment steps over rows with text signals and a raw result."""
    return (
        f"select doc_id, page_number, norm, case when sat then 'viasat_fatura' else t1 end as doc_type, "
        "case when sat then coalesce(supplier, 'Viasat') else supplier end as supplier, "
        "case when sat then greatest(c1, 0.9) else c1 end as confidence, source, "
        "case when sat then coalesce(m1, 'viasat') else m1 end as matched_pattern, is_continuation, cnpj from ("
        "select *, t1 in ('comprovante_pagamento', 'boleto_outros_bancos', 'desconhecido') and text_sat as sat from ("
        "select *, cont0 or text_cont as is_continuation, coalesce(nullif(cnpj0, ''), text_cnpj) as cnpj, "
        "case when sh then 'planilha_movimento_caixa' else doc_type end as t1, "
        "case when sh then greatest(confidence, 0.6) else confidence end as c1, "
        "case when sh then coalesce(matched_pattern, 'heuristica_planilha') else matched_pattern end as m1 from ("
        f"select *, doc_type = 'desconhecido' and {sheet('text')} as sh from {source})))"
    )


SINGLE = text_in(V.SINGLETON_TYPES)
VIEWS.update(
    {
        "classified": enriched("raw_result"),
        "neighbours": "select *, lag(page_number) over w as prev_page, lag(doc_type) over w as prev_type, lag(supplier) over w as prev_supplier, "
        "lag(cnpj) over w as prev_cnpj, lead(doc_type) over w as next_type from classified "
        "window w as (partition by doc_id order by page_number)",
        "features0": f"select *, {compatible('supplier', 'cnpj', 'prev_supplier', 'prev_cnpj')} as compat, "
        "doc_type = 'viasat_fatura' or contains(lower(concat_ws(' ', supplier, matched_pattern)), 'viasat') as satellite from neighbours",
        "features": "select *, prev_page is null as is_first, "
        "coalesce(prev_type in ('conta_energia', 'imposto_municipal') and (doc_type = prev_type or doc_type = 'desconhecido') "
        "and (confidence < 0.5 or doc_type = prev_type) and (compat or doc_type = 'desconhecido'), false) as bill, "
        f"coalesce(doc_type in {SINGLE} or prev_type in {SINGLE}, false) as alone, "
        f"coalesce(doc_type = prev_type and doc_type in {text_in(V.MULTIPAGE_TYPES)} and compat, false) as same_multi, "
        "coalesce(doc_type in ('boleto_outros_bancos', 'recibo_pagador') and prev_type = 'comprovante_pagamento' and next_type = 'nfe', false) as before_invoice, "
        f"doc_type = 'nfe' as is_nfe, doc_type in {text_in(V.BOLETO_CHAIN_TYPES)} as is_chain from features0",
        "walk": "select doc_id, page_number, 1 as g, satellite as s, is_nfe as n, is_chain as c from features where is_first "
        "union all select doc_id, page_number, case when att then g else g + 1 end, "
        "satellite or (att and s), is_nfe or (att and n), is_chain or (att and c) from ("
        "select f.*, w.g, w.s, w.n, w.c, case when f.is_continuation or f.bill then true when f.alone then false "
        "when w.s or f.satellite then f.satellite or (f.is_nfe and not w.n) "
        "else f.same_multi or (f.is_nfe and w.c) or f.before_invoice end as att "
        "from walk w join features f on f.doc_id = w.doc_id and f.page_number = w.page_number + 1)",
        "assigned": "select c.*, w.g as group_seq from classified c join walk w using (doc_id, page_number)",
        "groups": "select doc_id, group_seq, coalesce("
        + "coalesce("
        + ", ".join(f"max(case when doc_type = '{t}' then doc_type end)" for t in V.TYPE_PRIORITY)
        + "), arg_min(case when doc_type <> 'desconhecido' then doc_type end, case when doc_type <> 'desconhecido' then page_number end), 'desconhecido') as doc_type, "
        "arg_max(nullif(supplier, ''), case when supplier <> '' then length(supplier) * 100000 - page_number end) as supplier, "
        "min(page_number) as start_page, max(page_number) as end_page, bool_or(confidence < 0.8 or doc_type = 'desconhecido') as needs_review "
        "from assigned group by doc_id, group_seq",
        "copies": f"select *, {slug('doc_type')} as tslug, row_number() over (partition by doc_id, doc_type, coalesce(nullif(supplier, ''), 'none') order by group_seq) as copy from groups",
        "named": "select *, concat_ws('_', case when group_seq < 10 then '0' else '' end || cast(group_seq as varchar), tslug, "
        f"case when supplier <> '' then substr({slug('supplier')}, 1, 40) end, case when copy > 1 then 'via' || cast(copy as varchar) end) || '.pdf' as filename from copies",
        "idx": f"select doc_id, group_seq as number, filename, {label('doc_type')} as label, coalesce(nullif(supplier, ''), 'N/A') as supplier, "
        "case when start_page = end_page then cast(start_page as varchar) else start_page || '-' || end_page end as pages, "
        "end_page - start_page + 1 as page_count, case when needs_review then 'Sim' else 'Não' end as review from named",
        "answers0": "select doc_id, page_number, (doc_id * 7 + page_number) % 9 as kind from corpus where (doc_id * 7 + page_number) % 9 <= 6",
        "answers": "select doc_id, page_number, case kind when 0 then 'ipva' when 1 then 'nfe' when 5 then 'darf' else 'desconhecido' end as doc_type, "
        "case kind when 0 then 'Detran' end as supplier, cast(case kind when 0 then 0.95 when 1 then 1.0 when 3 then 0.3 when 5 then 0.85 else 0.0 end as double) as confidence, "
        "'llm' as source, case kind when 0 then 'guia' when 5 then 'viasat na fatura' end as matched_pattern, kind in (1, 5) as is_continuation, cast(null as varchar) as cnpj from answers0",
        "chosen": "select s.doc_id, s.page_number, s.text, s.norm, s.text_cont, s.text_cnpj, s.text_sat, "
        "case when take then a.doc_type else coalesce(rule_type, 'desconhecido') end as doc_type, case when take then a.supplier else rule_supplier end as supplier, "
        "case when take then a.confidence else coalesce(rule_conf, 0.0) end as confidence, case when take then 'llm' else 'rule' end as source, "
        "case when take then a.matched_pattern else rule_pattern end as matched_pattern, take and a.is_continuation as cont0, cast(null as varchar) as cnpj0 "
        "from (select s.*, coalesce(a.doc_type is not null and (rule_type is null or (rule_conf < 0.8 and a.doc_type <> 'desconhecido' and a.confidence >= rule_conf)), false) as take "
        "from signals s left join answers a using (doc_id, page_number)) s left join answers a using (doc_id, page_number)",
        "merged": enriched("chosen"),
        "shared0": "select c.*, s.text, s.text_cont, s.text_cnpj, s.text_sat, sha256(c.norm) as text_hash from classified c join signals s using (doc_id, page_number)",
        "firsts": "select * from shared0 where confidence > 0 qualify row_number() over (partition by text_hash order by doc_id, page_number) = 1",
        "reused": "select o.doc_id, o.page_number, o.text, o.norm, o.text_cont, o.text_cnpj, o.text_sat, o.text_hash, "
        "case when f.text_hash is null then o.doc_type else f.doc_type end as doc_type, case when f.text_hash is null then o.supplier else f.supplier end as supplier, "
        "case when f.text_hash is null then o.confidence else f.confidence end as confidence, case when f.text_hash is null then o.source else f.source end as source, "
        "case when f.text_hash is null then o.matched_pattern else f.matched_pattern end as matched_pattern, "
        "case when f.text_hash is null then o.is_continuation else f.is_continuation end as cont0, case when f.text_hash is null then o.cnpj else f.cnpj end as cnpj0 "
        "from shared0 o left join firsts f using (text_hash)",
        # ledger
        "people": "select c_custkey as id, lower(c_name) || '@example.com' as email, case when c_custkey % 100 = 0 then 'admin' else 'user' end as role, c_name as display_name, "
        "cast(floor(greatest(c_acctbal, 0.0)) as integer) as total_credits_mb, cast(case when c_custkey % 97 = 5 then floor(greatest(c_acctbal, 0.0)) + 1 "
        "else floor(floor(greatest(c_acctbal, 0.0)) * (c_custkey % 11) / 10) end as integer) as used_credits_mb, cast(c_custkey % 3 as integer) as free_uses_today, "
        "case when c_custkey % 5 <> 4 then timestamp '2024-01-30 08:00:00' - to_days(cast(c_custkey % 4 as integer)) end as last_free_use, "
        "cast(c_custkey % 4 as integer) as pdf_tools_uses_today, case when c_custkey % 7 <> 6 then timestamp '2024-01-30 09:00:00' - to_days(cast(c_custkey % 3 as integer)) end as pdf_tools_last_use, "
        "timestamp '2023-01-01 00:00:00' + to_minutes(c_custkey * 37) as created_at from customer",
        "bought0": f"select o_orderkey as id, o_custkey as user_id, {cents('o_totalprice / 10')} as amount_brl, cast(floor(o_totalprice / 100) as integer) as credits_mb, "
        "case o_orderpriority when '1-URGENT' then 'credit_card' when '2-HIGH' then 'pix' when '3-MEDIUM' then 'ticket' when '4-NOT SPECIFIED' then 'visa' else 'invoice' end as payment_method, "
        "case when o_orderpriority = '5-LOW' then 'invoice_' || o_orderkey else cast(o_orderkey as varchar) end as payment_id, "
        "case when o_orderstatus = 'F' and o_orderkey % 10 = 3 then 'refunded' when o_orderstatus = 'F' then 'approved' when o_orderstatus = 'P' then 'partially_refunded' else 'pending' end as payment_status, "
        "o_orderdate + to_minutes(o_orderkey % 1440) as created_at, "
        f"{cents('(o_orderkey % 7) * 13')} as fee_brl, case when o_orderpriority = '5-LOW' then 'admin_manual' else 'mercadopago_fulfillment' end as source, "
        "case when o_orderpriority <> '5-LOW' then (['basic', 'plus', 'pro', 'premium'])[o_orderkey % 4 + 1] end as package_id, "
        "case when o_orderpriority = '5-LOW' and o_orderkey % 3 <> 0 then 'note ' || o_orderkey end as note from orders",
        "bought": f"select *, case when id % 50 <> 0 then created_at + to_days(90) end as expires_at, case when id % 4 <> 0 then cast(greatest(amount_brl - fee_brl, 0) as {CENT}) end as net_amount_brl, "
        f"cast(case payment_status when 'refunded' then amount_brl when 'partially_refunded' then {cents('cast(amount_brl as double) * 25')} else 0 end as {CENT}) as refunded_amount_brl, "
        "case payment_status when 'refunded' then credits_mb when 'partially_refunded' then cast(floor(credits_mb / 4) as integer) else 0 end as refunded_credits_mb from bought0",
        "work": f"select event_id as id, user_id, 'f' || event_id || '.pdf' as filename, {cents('greatest(value, 1.0)')} as file_size_mb, cast(1 + event_id % 25 as integer) as pages_count, "
        "case event_type when 'error' then 'failed' when 'click' then 'processing' else 'completed' end as status, ts as created_at, "
        "case when event_id % 17 = 0 then '10.0.0.' else '200.10.0.' end || (user_id % 50) as ip_address from events",
        "used_ip0": "select event_id, ts, user_id, 'u' || user_id || '@example.com' as email, case when event_id % 17 = 0 then '10.0.0.' else '200.10.0.' end || (user_id % 50) as ip_address, "
        "case when event_type in ('signup', 'purchase') then 'tool' else 'free' end as kind from events",
        "used_ip": f"select ip, cast(ts as date) as usage_date, count(*) filter (kind = 'free') as free_process_count, count(*) filter (kind = 'tool') as tool_use_count, "
        "arg_max(user_id, (ts, event_id)) as last_user_id, arg_max(email, (ts, event_id)) as last_email, max(ts) as updated_at "
        f"from (select *, {usable('ip_address')} as ip from used_ip0) where ip is not null group by 1, 2",
        "spend": "select id as user_id, (id * 13) % 90 - 5 as available_mb from people",
        "credits": f"select u.id as user_id, coalesce(b.mb, 0) - u.used_credits_mb as available_mb from people u left join (select user_id, cast(sum(credits_mb) as bigint) as mb from bought "
        f"where payment_status = 'approved' and (expires_at is null or expires_at > {LEDGER_AS_OF}) group by 1) b on b.user_id = u.id",
        "given": f"select o_orderkey as id, o_custkey as user_id, case when o_orderkey % 6 <> 0 then cast(floor(o_custkey / 100) * 100 as bigint) end as granted_by, cast(floor(o_totalprice / 100) as integer) as credits_mb, "
        f"{cents('o_totalprice / 10')} as amount_brl, case when o_orderkey % 3 <> 0 then 'note ' || o_orderkey end as note, o_orderkey as transaction_id, o_orderdate + to_minutes(o_orderkey % 1440) as created_at from orders where o_orderpriority = '5-LOW'",
        "refund_log": f"select o_orderkey as id, o_orderkey as transaction_id, o_custkey as user_id, case when o_orderkey % 4 <> 0 then cast(0 as bigint) end as requested_by, 'completed' as status, {cents('o_totalprice / 40')} as amount_brl, "
        "cast(floor(o_totalprice / 400) as integer) as credits_mb, o_orderdate + to_minutes(o_orderkey % 1440) as created_at from orders where o_orderstatus = 'P'",
        "work_seq": "select w.*, cast(s.available_mb as bigint) as budget, row_number() over (partition by w.user_id order by w.created_at, w.id) as seq from work w join spend s using (user_id)",
        "balances_of": "select user_id, available_mb, greatest(total_credits_mb - used_credits_mb, 0) as shown from spend join people on people.id = user_id",
        "spending": "select id, user_id, created_at, file_size_mb, seq, budget as before, budget >= file_size_mb as ok, "
        "budget - case when budget >= file_size_mb then cast(round(file_size_mb, 0) as bigint) else 0 end as after from work_seq where seq = 1 "
        "union all select w.id, w.user_id, w.created_at, w.file_size_mb, w.seq, s.after, s.after >= w.file_size_mb, "
        "s.after - case when s.after >= w.file_size_mb then cast(round(w.file_size_mb, 0) as bigint) else 0 end from spending s join work_seq w on w.user_id = s.user_id and w.seq = s.seq + 1",
        "admitted": "select w.id, w.user_id, w.ip, w.file_size_mb, w.pages_count, case when p.id is null then 'unknown_user' when p.role = 'admin' then 'admin' when s.available_mb >= w.file_size_mb and s.available_mb > 0 then 'credits' "
        f"when {counter('p.free_uses_today', 'p.last_free_use')} >= 1 then 'user_daily_limit' when w.ip is not null and coalesce(i.free_process_count, 0) >= 1 then 'ip_daily_limit' "
        "when w.file_size_mb > 2 then 'file_too_large' when w.pages_count > 10 then 'too_many_pages' else 'free' end as mode "
        f"from (select *, {usable('ip_address')} as ip from work) w left join people p on p.id = w.user_id left join spend s on s.user_id = w.user_id left join used_ip i on i.ip = w.ip and i.usage_date = date '2024-01-30'",
        "replay0": f"select w.id, w.user_id, {usable('w.ip_address')} as ip, w.file_size_mb, w.pages_count, cast(w.created_at as date) as day, w.created_at, p.role = 'admin' as admin, coalesce(c.ok, false) as by_credits "
        "from work w join people p on p.id = w.user_id left join spending c on c.id = w.id",
        "replay": "select *, row_number() over (partition by day order by created_at, id) as seq from replay0 where not admin and not by_credits",
        "day_walk": "select day, cast(0 as bigint) as seq, cast([] as bigint[]) as us, cast([] as varchar[]) as ips, cast(null as bigint) as id, cast(null as varchar) as mode from (select distinct day from replay) "
        "union all select day, seq, case when m = 'free' then list_append(us, user_id) else us end, case when m = 'free' and ip is not null then list_append(ips, ip) else ips end, id, m from ("
        "select d.day, d.us, d.ips, r.seq, r.user_id, r.ip, r.id, case when list_contains(d.us, r.user_id) then 'user_daily_limit' when r.ip is not null and list_contains(d.ips, r.ip) then 'ip_daily_limit' "
        "when r.file_size_mb > 2 then 'file_too_large' when r.pages_count > 10 then 'too_many_pages' else 'free' end as m from day_walk d join replay r on r.day = d.day and r.seq = d.seq + 1)",
        "tools": f"select e.event_id as id, e.user_id, {usable(_USE_ADDRESS)} as ip, cast(e.ts as date) as day, e.ts, coalesce(p.role = 'admin' or s.available_mb > 0, false) as unlimited "
        "from events e left join people p on p.id = e.user_id left join spend s on s.user_id = e.user_id where e.event_type in ('signup', 'purchase')",
        "tool_turns": "select *, row_number() over (partition by day order by ts, id) as seq from tools where not unlimited",
        "tool_walk": "select day, cast(0 as bigint) as seq, cast([] as bigint[]) as us, cast([] as varchar[]) as ips, cast(null as bigint) as id, cast(null as varchar) as mode from (select distinct day from tool_turns) "
        "union all select day, seq, case when m = 'accepted' then list_append(us, user_id) else us end, case when m = 'accepted' and ip is not null then list_append(ips, ip) else ips end, id, m from ("
        "select d.day, d.us, d.ips, r.seq, r.user_id, r.ip, r.id, case when len(list_filter(d.us, lambda x: x = r.user_id)) >= 2 or (r.ip is not null and len(list_filter(d.ips, lambda x: x = r.ip)) >= 2) then 'refused' else 'accepted' end as m "
        "from tool_walk d join tool_turns r on r.day = d.day and r.seq = d.seq + 1)",
        "edits": "select conv_id as post_id, cast(turn as integer) as edit_ord, timestamp '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) as ts, case when turn = 0 or turn % 3 = 1 then text end as title, "
        "case when turn % 2 = 0 then substr(text, 61) end as excerpt, text as body_md, case when turn % 4 = 2 then 'cover-' || conv_id end as cover_url, case when turn = 3 then 'Edição Nº ' || conv_id end as slug, "
        "case when turn % 4 = 0 then conv_id % 2 = 0 when turn % 4 = 2 then true when turn % 4 = 3 and conv_id % 3 = 0 then false end as published, "
        "case when role = 'assistant' then 'editor@example.com' when turn = 0 then 'autor@example.com' end as author_email from conversations",
        "edits2": f"select *, case when edit_ord = 0 then coalesce(published, false) else published end as pub, case when edit_ord = 0 then coalesce(nullif(slug, ''), title) else slug end as slug_src from edits",
        "posts0": "select post_id, "
        + ", ".join(
            f"arg_max({e}, case when {e} is not null then edit_ord end) as {n}"
            for n, e in (
                ("slug", f"(case when slug_src is not null then {blog_slug('slug_src', 'ts')} end)"),
                ("title", strip("title")),
                ("excerpt0", strip("excerpt")),
                ("body_md", strip("body_md")),
                ("cover_url", "cover_url"),
                ("pub_last", "pub"),
                ("author_email", "nullif(author_email, '')"),
            )
        )
        + ", arg_min(ts, edit_ord) as created_at, arg_max(ts, edit_ord) as updated_at, max(case when not pub then edit_ord end) as last_off from edits2 group by post_id",
        "posts": "select p.post_id, slug, title, coalesce(excerpt0, '') as excerpt, body_md, cover_url, coalesce(pub_last, false) as published, author_email, created_at, updated_at, "
        "case when pub_last then (select min(e.ts) from edits2 e where e.post_id = p.post_id and e.pub and e.edit_ord > coalesce(p.last_off, -1)) end as published_at from posts0 p",
        # payments
        "steps": "select *, unnest(generate_series(0, cast(o_orderkey % 3 as integer))) as step from orders",
        "notes": "select o_orderkey as k, cast(o_orderkey as varchar) as payment_id, step, case when o_orderkey % 11 = 7 then case when step = 0 then 'pending' else 'rejected' end when step = 2 and o_orderkey % 5 = 1 then 'refunded' "
        "when o_orderstatus = 'O' and step = 0 then 'pending' else 'approved' end as status, floor(o_totalprice / 1000) + case when o_orderkey % 2 = 0 then 0.5 else 0.0 end as amount, "
        "case when o_orderkey % 5 = 2 or o_orderkey % 13 <> 4 then lpad(cast(o_custkey as varchar), 36, '0') end as user_id, "
        "case when o_orderkey % 5 = 2 or o_orderkey % 7 <> 1 then (['basic', 'plus', 'pro', 'premium'])[o_orderkey % 4 + 1] end as package_id, "
        "case when o_orderkey % 7 = 3 then 123 end as meta_mb, case when o_orderkey % 3 = 0 then 'pix' when o_orderkey % 3 = 1 then 'master' when o_orderkey % 6 = 2 then 'account_money' else 'mercadopago' end as payment_method, "
        "case when o_orderkey % 4 <> 0 then (o_orderkey % 9 + step) * 0.25 else 0 end as listed, case when o_orderkey % 8 <> 0 then floor(o_totalprice / 1000) + case when o_orderkey % 2 = 0 then 0.5 else 0.0 end - 0.75 else 0 end as net, "
        "o_orderdate + to_hours(step) as ts from steps",
        "paid": f"select payment_id, ts, status, user_id, package_id, cast(coalesce(meta_mb, case package_id when 'basic' then 50 when 'plus' then 200 when 'pro' then 500 when 'premium' then 1000 end, "
        "case round_even(amount, 0) when 5 then 50 when 15 then 200 when 30 then 500 when 50 then 1000 else greatest(round_even(amount, 0) * 10, 0) end) as integer) as credits_mb, payment_method, "
        f"cast(amount as {CENT}) as amount_brl, cast(round(case when listed > 0 then listed when amount > 0 and net >= 0 and net <= amount then amount - net else 0 end, 2) as {CENT}) as fee_brl from notes",
        "paid2": f"select *, cast(greatest(amount_brl - fee_brl, 0) as {CENT}) as net_amount_brl, status in ('approved', 'refunded', 'partially_refunded') as final from paid where user_id is not null",
        "kept": "select * from paid2 qualify row_number() over (partition by payment_id order by final desc, case when final then epoch(ts) else -epoch(ts) end) = 1",
        "latest": "select * from paid2 qualify row_number() over (partition by payment_id order by ts desc) = 1",
        "fulfilled": "select k.payment_id, k.user_id, k.package_id, k.status as payment_status, k.credits_mb, k.amount_brl, case when k.status = 'approved' then l.fee_brl else k.fee_brl end as fee_brl, "
        "case when k.status = 'approved' then l.net_amount_brl else k.net_amount_brl end as net_amount_brl, case when k.status = 'approved' then l.payment_method else k.payment_method end as payment_method, "
        "case when k.status = 'approved' then k.ts end as approved_at, k.ts + to_days(90) as expires_at, case when k.status = 'approved' and k.credits_mb > 0 then k.credits_mb else 0 end as credited_mb, "
        "(select count(*) from paid2 p where p.payment_id = k.payment_id) as notices from kept k join latest l using (payment_id)",
        "provider": f"select cast(o_orderkey as varchar) as payment_id, case when o_orderkey % 2 = 0 then 'pix' else 'master' end as pmethod, case when o_orderkey % 2 = 0 then 'bank_transfer' else 'credit_card' end as ptype, "
        f"case when o_orderkey % 15 = 0 then 'charged_back' else 'approved' end as pstatus, {cents('(o_orderkey % 5) * 21')} as pfee from orders where o_orderpriority <> '5-LOW' and o_orderkey % 3 = 0",
        "terms0": f"select b.*, greatest(u.total_credits_mb - u.used_credits_mb, 0) as available_mb, coalesce(nullif(p.pmethod, ''), b.payment_method) as method, p.ptype, p.pstatus, "
        f"cast(case when p.pfee > 0 then p.pfee else b.fee_brl end as {CENT}) as fee from bought b join people u on u.id = b.user_id left join provider p using (payment_id)",
        "terms1": f"select *, {deducts('method', 'ptype')} as deduct_fee, lower(coalesce(method, '')) in {text_in(V.PREVIEW_INVOICE_METHODS)} or starts_with(payment_id, 'invoice_') as inv from terms0",
        "terms": f"select *, cast(greatest(amount_brl - case when deduct_fee then fee else 0 end - refunded_amount_brl, 0) as {CENT}) as max_money, greatest(credits_mb - refunded_credits_mb, 0) as pack_left from terms1",
        "standing": "select *, case when payment_status not in ('approved', 'partially_refunded') then 'Pagamento não está aprovado.' end as r1, "
        "case when pack_left <= 0 or refunded_amount_brl >= amount_brl then 'Transação já reembolsada.' end as r2, "
        "case when pstatus <> '' and pstatus <> 'approved' then 'Status no Mercado Pago: ' || pstatus || '.' end as r5 from terms",
        "preview0": "select *, least(available_mb, pack_left) as claw from standing",
        "preview": f"select *, cast(case when pack_left <= 0 then 0 when claw = pack_left then max_money else {refund_share('claw')} end as {CENT}) as money from preview0",
        "refund_seq": "select *, row_number() over (partition by user_id order by id) as seq from standing where r1 is null and r2 is null and r5 is null and (inv or max_money > 0)",
        "refund_walk": "select user_id, cast(0 as bigint) as seq, max(available_mb) as rest, cast(null as bigint) as id, cast(0 as integer) as claw, false as ok from refund_seq group by user_id "
        "union all select user_id, seq, case when ok then rest - claw else rest end, id, claw, ok from (select *, claw > 0 and (inv or claw = pack_left or " + refund_share("claw") + " > 0) as ok "
        "from (select r.*, w.rest, least(w.rest, r.pack_left) as claw from refund_walk w join refund_seq r on r.user_id = w.user_id and r.seq = w.seq + 1))",
        # lines and corrections
        "laid": "select doc_id, cast((i - 1) // 20 + 1 as integer) as page_number, cast((i - 1) % 20 as integer) as line_ord, 40.0 as x0, 30.0 + ((i - 1) % 20) * 36.0 as y0, 41.0 + least(length(line), 80) * 6.0 as x1, 44.0 + ((i - 1) % 20) * 36.0 as y1, line as text from lines",
        "boxes0": "select doc_id, cast(1 + (doc_id + k) % 4 as integer) as page_number, cast(k as integer) as correction_ord, 45.0 + case k when 1 then 1.0 when 3 then 400.0 else 90.0 end as bx, "
        "cast(30 + (doc_id * 7 + k * 11) % 760 as double) as y, case k when 1 then 1.0 when 3 then 300.0 else 44.0 end as h, case k when 1 then 1.0 when 3 then 400.0 else 90.0 end as w, 'corrigido ' || k as new_text from documents, range(4) r(k)",
        "boxes": "select *, greatest(45.0 - pad, 0) as sx0, greatest(y - pad, 0) as sy0, least(bx + pad, 612.0) as sx1, least(y + h + pad, 792.0) as sy1 from (select *, case when w < 2 and h < 2 then 3.0 else 0.0 end as pad from boxes0)",
        "picked0": "select b.doc_id, b.page_number, b.correction_ord, b.new_text, l.line_ord, "
        "case when sx1 - sx0 < 8 and sy1 - sy0 < 8 then case when (sx0 + sx1) / 2 >= x0 and (sx0 + sx1) / 2 < x1 and (sy0 + sy1) / 2 >= y0 and (sy0 + sy1) / 2 < y1 then 1000.0 - abs((y0 + y1) / 2 - (sy0 + sy1) / 2) "
        "when abs((y0 + y1) / 2 - (sy0 + sy1) / 2) <= 18 then 100.0 - abs((y0 + y1) / 2 - (sy0 + sy1) / 2) else 0 end "
        "when least(x1, sx1) > greatest(x0, sx0) and least(y1, sy1) > greatest(y0, sy0) then (least(x1, sx1) - greatest(x0, sx0)) * (least(y1, sy1) - greatest(y0, sy0)) else 0 end as score "
        "from boxes b join laid l on l.doc_id = b.doc_id and l.page_number = b.page_number where sx0 < sx1 and sy0 < sy1",
        "picked": "select * from picked0 where score > 0 qualify row_number() over (partition by doc_id, page_number, correction_ord order by score desc, line_ord) = 1",
        "sizes": "select doc_id, cast(count(*) as integer) as total_pages from corpus group by doc_id",
        "split0": "select doc_id, total_pages, case doc_id % 5 when 1 then [(1, 2), (2, 2)] when 2 then [(1, 3), (1, 1)] when 3 then [(2, 2)] when 4 then [(cast(1 as integer), cast(null as integer))] "
        "else list_transform(range(1, total_pages + 1), lambda p: (cast(p as integer), cast(p as integer))) end as pairs from sizes",
        "split1": "select doc_id, total_pages, cast(generate_subscripts(pairs, 1) as integer) as part, unnest(pairs) as pair from split0",
        "splits": "select doc_id, part, case when doc_id % 5 <> 4 then pair[1] end as start_page, case when doc_id % 5 <> 4 then pair[2] end as end_page, "
        "case when doc_id % 5 = 4 or pair[1] < 1 or pair[2] < pair[1] or pair[2] > total_pages then 'invalid_range' end as error from split1",
    }
)


def _needed(body: str) -> list[str]:
    """Views a statement uses, directly or through others, in definition order."""
    import re

    names = list(VIEWS)
    found: set[str] = set()
    queue = [body]
    while queue:
        words = set(re.findall(r"[a-z_0-9]+", queue.pop()))
        for name in names:
            if name in words and name not in found:
                found.add(name)
                queue.append(VIEWS[name])
    return [name for name in names if name in found]


def statement(body: str) -> str:
    views = ", ".join(f"{name} as ({VIEWS[name]})" for name in _needed(body))
    return f"with recursive {views} {body}" if views else body


_AMOUNT, _DUE, _PAID = (
    r"R\$\s*(\d{1,3}(?:\.\d{3})*,\d{2})",
    r"(?i)vencimento\D{0,20}(\d{2}/\d{2}/\d{4})",
    r"(?i)pagamento\D{0,20}(\d{2}/\d{2}/\d{4})",
)


def _first_field(pattern: str) -> str:
    hit = f"nullif(regexp_extract(text, '{pattern}', 1), '')"
    return f"arg_min({hit}, case when {hit} is not null then page_number end)"


_MARKED = (
    "(select doc_id, page_number, " + norm(
        "text || case doc_id % 6 when 0 then ' Página ' || page_number || ' de ' || (page_number + doc_id % 4 - 1) "
        "when 1 then ' folha ' || page_number || '/' || (page_number + doc_id % 4 - 1) when 2 then ' ' || page_number || 'de' || (page_number + doc_id % 4 - 1) || ' ' "
        "when 3 then ' 10 de 20 ' || page_number || 'de' || (page_number + doc_id % 4 - 1) when 4 then ' continuação ' else '' end"
    ) + " as marked from texts)"
)
_UPLOADS = (
    "(select doc_id, 'd' || doc_id || case doc_id % 10 when 3 then '.txt' when 4 then '.PDF' else '.pdf' end as filename, "
    "case when doc_id % 31 = 0 then 0 else n_chars * 2500 end as length, case when doc_id % 37 = 1 then 0 else len(string_split(text, chr(10))) end as pages from documents)"
)
_ADDRESSES = (
    "(select event_id, user_id, (['10.0.0.' || (user_id % 50), ' 200.10.0.' || (user_id % 50), '192.168.0.' || (user_id % 50), 'FC00::' || (user_id % 50), 'localhost', '', "
    "'172.16.0.' || (user_id % 50), 'Unknown'])[event_id % 8 + 1] as ip_address from events)"
)
_PAID_FILTER = f"not {invoice('payment_method', 'payment_id')} and payment_status in ('approved', 'partially_refunded', 'refunded')"
_RECENT = (
    "(select user_id, cast(sum(file_size_mb) as decimal(18,2)) as mb, count(*) as n from work group by user_id)"
)
_DAMAGED = (
    "(select doc_id, start_page, case when doc_id % 7 = 2 and group_seq % 3 = 1 then end_page + 1 when doc_id % 11 = 4 and group_seq = 1 then start_page - 1 else end_page end as end_page "
    "from groups where doc_id % 17 <> 3 and not (doc_id % 5 = 1 and group_seq = 2))"
)
_REQUEST = (
    "'Texto extraído da página ' || page_number || ':' || chr(10) || '\"\"\"' || chr(10) || substr(" + strip("t.text") + ", 1, 6000) || chr(10) || '\"\"\"' || chr(10) || chr(10) || "
    "'Tipo de documento da página anterior (se houver): ' || coalesce(nullif(f.prev_type, ''), 'nenhum') || chr(10) || 'Fornecedor da página anterior (se houver): ' || coalesce(nullif(f.prev_supplier, ''), 'nenhum') || chr(10)"
)
_REQUESTS = (
    f"(select f.doc_id, f.page_number, f.prev_type, f.prev_supplier, {_REQUEST} as request from features f join (select s.doc_id, s.page_number, s.text, s.rule_conf from signals s) t using (doc_id, page_number) where coalesce(t.rule_conf, 0) < 0.8)"
)
_GRANT_REQ = (
    "(select o_orderkey as request_id, case when o_orderkey % 2 = 0 then ' CUSTOMER#' else 'customer#' end || lpad(cast(o_custkey * case when o_orderkey % 20 = 0 then 9999 else 1 end as varchar), 9, '0') || '@Example.com ' as email, "
    f"cast(floor(o_totalprice / 100) - 300 as integer) as credits_mb, {cents('o_totalprice / 10')} as amount_brl, case when o_orderkey % 3 = 0 then 'n' || o_orderkey end as note, "
    "coalesce(case when o_orderkey % 4 <> 0 then cast(o_orderkey % 400 as integer) end, 90) as days_valid from orders where o_orderpriority = '5-LOW')"
)
_GRANT_OK = "credits_mb between 1 and 100000 and amount_brl >= 0 and days_valid between 1 and 3650"
_GRANT_MATCH = f"(select r.*, u.id as user_id, u.total_credits_mb, u.used_credits_mb from {_GRANT_REQ} r join people u on lower(u.email) = lower(trim(r.email)) where {_GRANT_OK.replace('credits_mb', 'r.credits_mb')})"

_USER_MATCHES = (
    "(select t.doc_id, t.page_number, r.* from texts t join (select *, " + norm("pattern") + " as pnorm from ("
    "select item_id as rule_ord, 'item_' || (item_id % 50) as doc_type, cast(item_id % 40 as double) / 100 + 0.5 as confidence, 0 as pattern_ord, substr(text, 1, 20) as pattern from benchmark "
    "union all select item_id, 'item_' || (item_id % 50), cast(item_id % 40 as double) / 100 + 0.5, 1, substr(text, 31, 8) from benchmark)) r "
    "on r.pnorm <> '' and contains(t.norm, r.pnorm))"
)

BODIES: dict[str, str] = {
    "page_corpus": "select * from corpus",
    "upload_admission": "select doc_id, filename, reason is null as admitted, reason from (select *, case when not ends_with(lower(filename), '.pdf') then 'not_pdf' when length = 0 then 'empty' "
    f"when length > 4 * 1048576 then 'too_large' when pages = 0 then 'no_pages' when pages > 20 then 'too_many_pages' end as reason from {_UPLOADS})",
    "upload_size_mb": f"select doc_id, cast(greatest(round(cast(length as decimal(20,10)) / 1048576, 2), 0.01) as decimal(18,2)) as file_size_mb from {_UPLOADS}".replace("decimal(20,10)", "double"),
    "rules_table": "select r.rule_ord, r.doc_type, r.patterns, r.has_supplier, r.confidence, coalesce(m.pages, 0) as pages from (values "
    + ", ".join(
        f"({i}, '{r.doc_type}', '{'|'.join(r.patterns)}', {str(r.supplier_pattern is not None).lower()}, cast({r.confidence} as double))"
        for i, r in enumerate(V.SHIPPED_RULES)
    )
    + ") r(rule_ord, doc_type, patterns, has_supplier, confidence) left join (select rule_ord, count(distinct (doc_id, page_number)) as pages from texts t join ("
    + _rules_values(V.SHIPPED_RULES)
    + ") s(rule_ord, pattern_ord, doc_type, pattern, confidence, plen) on contains(t.norm, s.pattern) group by 1) m using (rule_ord)",
    "packages": "select p.id, cast(p.price as decimal(10,2)) as price_brl, p.mb as credits_mb, p.label, 'R$ ' || p.price || '.00' as price_formatted, p.mb || ' MB' as credits_formatted, "
    "coalesce(b.n, 0) as purchases, cast(coalesce(b.s, 0) as decimal(18,2)) as amount_brl from (values ('basic', 5, 50, 'Básico'), ('plus', 15, 200, 'Plus (Bônus 33%)'), ('pro', 30, 500, 'Pro (Bônus 67%)'), ('premium', 50, 1000, 'Premium (Bônus 100%)')) p(id, price, mb, label) "
    "left join (select package_id, count(*) as n, sum(amount_brl) as s from bought group by 1) b on b.package_id = p.id",
    "ledger_tables": "select id, user_id, filename, file_size_mb, created_at from work where status = 'completed' and user_id in (select x from range(0, 150, 7) r(x)) order by created_at desc, id desc limit 200",
    "index_sink": "select * from idx",
    "document_sink": "select n.doc_id, n.filename, c.page_number, c.native_text from named n join corpus c on c.doc_id = n.doc_id and c.page_number between n.start_page and n.end_page",
    "cache_sink": "select text_hash, doc_type, confidence, source, matched_pattern, is_continuation from firsts",
    "job_ledger": "select event_id // 2 as job_id, arg_max(ts, o) as ts, arg_max(status, o) as status, arg_max((documents_count).x, o) as documents_count, arg_max((error_message).x, o) as error_message from ("
    "select *, (ts, case when status = 'processing' then 0 else 1 end) as o from (select event_id, ts, case when event_id % 2 = 1 and event_type = 'error' then 'failed' when event_id % 2 = 1 then 'completed' else 'processing' end as status, "
    "{'x': case when event_id % 2 = 1 and event_type <> 'error' then cast(event_id % 9 as integer) end} as documents_count, {'x': case when event_id % 2 = 1 and event_type = 'error' then 'falha ' || props end} as error_message from events)) group by 1",
    "best_text": "select doc_id, page_number, text from texts",
    "normalize_text": "select doc_id, page_number, norm from texts",
    "text_hash": "select doc_id, page_number, sha256(norm) as text_hash from texts",
    "looks_like_spreadsheet": f"select doc_id, page_number, {sheet('text')} as sheet from texts",
    "slugify": f"select doc_id, page_number, {slug('text')} as slug from texts",
    "needs_ocr": "select doc_id, count(*) filter (coalesce(length(native_text), 0) < 50) as needs_ocr_pages from corpus group by 1",
    "extract_cnpj": f"select * from (select doc_id, page_number, {cnpj('text')} as cnpj from texts) where cnpj is not null",
    "cnpj_base": f"select *, substr(cnpj, 1, 8) as base from (select doc_id, page_number, {cnpj('text')} as cnpj from texts) where cnpj is not null",
    "page_x_of_y": f"select doc_id, page_number, m.c as current_page, m.t as total_pages from (select doc_id, page_number, {markers('marked')} as m from {_MARKED})",
    "is_continuation": f"select doc_id, page_number, contains(marked, 'continuacao') or coalesce({markers('marked')}.c >= 2, false) as continues from {_MARKED}",
    "extract_supplier": f"select * from (select doc_id, page_number, {supplier('text', '([a-z]{4,}tion(?:[ ,:-]+[a-z.]+){0,9})')} as supplier from texts) where supplier is not null",
    "clean_supplier": f"select *, {cleaned('supplier')} as cleaned from (select doc_id, page_number, {supplier('text', '([a-z]{4,}tion(?:[ ,:-]+[a-z.]+){0,9})')} as supplier from texts) where supplier is not null",
    "supplier_compat": "select doc_id, page_number, compat as compatible from features where not is_first",
    "blog_slug": f"select post_id, edit_ord, {blog_slug('title', 'ts')} as slug from edits where title is not null",
    "page_range": "select doc_id, group_seq, case when start_page = end_page then cast(start_page as varchar) else start_page || '-' || end_page end as pages from groups",
    "doc_type_label": f"select doc_type, count(*) as pages, {label('doc_type')} as label from (select doc_type from classified union all select replace(o_orderpriority, '-', '_') from orders) group by doc_type",
    "is_viasat": "select doc_id, page_number, satellite from features",
    "usable_ip": f"select event_id, {usable('ip_address')} as ip from {_ADDRESSES}",
    "client_ip": "select event_id, coalesce(trim(split_part(h, ',', 1)), p, 'unknown') as client_ip from (select event_id, coalesce(nullif(case when event_id % 3 = 0 then ip_address end, ''), nullif(case when event_id % 3 <> 2 then ip_address || ' , 10.1.1.1' end, '')) as h, "
    f"case when event_id % 4 <> 0 then 'peer' || user_id end as p from {_ADDRESSES})",
    "is_admin": "select id, role = 'admin' or email = 'customer#000000007@example.com' as admin from people",
    "page_request_text": f"select doc_id, page_number, request from {_REQUESTS}",
    "rule_matches": "select doc_id, page_number, rule_ord, pattern_ord, doc_type, pattern, confidence, plen as pattern_length from matches",
    "page_rule_theta": "select rule_ord, pattern_ord, pattern, count(*) as pages, count(distinct doc_id) as documents from matches group by 1, 2, 3",
    "rule_table_matches": f"select rule_ord, pattern_ord, pattern, count(*) as pages from {_USER_MATCHES} group by 1, 2, 3",
    "rule_table_winners": f"select doc_id, page_number, rule_ord, pattern_ord, doc_type, pattern, confidence from {_USER_MATCHES} "
    "qualify row_number() over (partition by doc_id, page_number order by confidence desc, length(pnorm) desc, rule_ord, pattern_ord) = 1",
    "classify_rules": "select doc_id, page_number, rule_type as doc_type, rule_conf as confidence, rule_pattern as matched_pattern, text_cont as is_continuation, text_cnpj as cnpj from signals where rule_type is not null",
    "classify_supplier": "select doc_id, page_number, rule_type as doc_type, rule_supplier as supplier from signals where rule_type is not null",
    "classify_enrich": "select doc_id, page_number, doc_type, confidence, matched_pattern, cnpj from classified",
    "classify_pages": "select * exclude (norm) from classified",
    "fallback_requests": f"select doc_id, page_number, prev_type as previous_doc_type, prev_supplier as previous_supplier, cast(length(request) as integer) as request_length from {_REQUESTS}",
    "fallback_parse": "select * from answers",
    "fallback_merge": "select * exclude (norm) from merged",
    "classify_distinct": "select r.doc_id, r.page_number, sha256(r.norm) as text_hash, r.* exclude (doc_id, page_number, norm) from (" + enriched("reused") + ") r",
    "classify_stats": "select count(*) as total_pages, count(*) filter (confidence >= 0.8) as accepted_pages, count(*) filter (confidence < 0.8) as low_confidence_pages, round(count(*) filter (confidence >= 0.8) * 100.0 / count(*), 1)::double as accepted_pct from classified",
    "rule_candidates": "select doc_type, count(*) as suggested_pages from merged where source = 'llm' group by 1",
    "group_features": "select doc_id, page_number, prev_type as prev_doc_type, prev_supplier, next_type as next_doc_type, is_first, alone, satellite, same_multi as same_multipage, before_invoice as chain_before_invoice from features",
    "back_of_bill": "select doc_id, page_number, bill as back_of_bill from features",
    "group_pages": "select doc_id, page_number, doc_type, group_seq from assigned",
    "should_group_pairwise": "select f.doc_id, f.page_number, case when f.is_continuation or f.bill then true when f.alone then false when p.satellite or f.satellite then f.satellite or (f.is_nfe and not p.is_nfe) "
    "else f.same_multi or (f.is_nfe and p.is_chain) end as attaches from features f join features p on p.doc_id = f.doc_id and p.page_number = f.page_number - 1",
    "build_groups": "select doc_id, group_seq, start_page, end_page, needs_review from groups",
    "pick_doc_type": "select doc_id, group_seq, doc_type from groups",
    "pick_supplier": "select doc_id, group_seq, supplier from groups",
    "coverage_check": f"select doc_id, 'inverted' as violation, start_page as page_number from {_DAMAGED} where start_page > end_page union all "
    f"select doc_id, 'no_groups', null from sizes where doc_id not in (select doc_id from {_DAMAGED}) union all "
    f"select doc_id, case when cnt is null then 'missing' when cnt > 1 then 'overlap' else 'extra' end, page_number from ("
    f"select doc_id, cast(page_number as integer) as page_number, c.cnt, e.ex from (select doc_id, page_number, count(*) as cnt from (select doc_id, unnest(generate_series(start_page, end_page)) as page_number from {_DAMAGED} where start_page <= end_page) group by 1, 2) c "
    f"full join (select doc_id, unnest(generate_series(1, total_pages)) as page_number, true as ex from sizes where doc_id in (select doc_id from {_DAMAGED})) e using (doc_id, page_number)) where cnt is null or cnt > 1 or ex is null",
    "filenames": "select doc_id, group_seq, filename from named",
    "index_report": "select * from idx",
    "result_stats": "select doc_id, count(*) as total_documents, cast(sum(end_page - start_page + 1) as bigint) as total_pages, count(*) filter (needs_review) as needs_review from groups group by 1",
    "index_search": f"select doc_id, group_seq, filename from named where contains(lower(filename || ' ' || {label('doc_type')} || ' ' || coalesce(supplier, '')), 'fiscal')",
    "group_text_fields": f"select doc_id, group_seq, {_first_field(_AMOUNT)} as amount, {_first_field(_DUE)} as due_date, {_first_field(_PAID)} as paid_date, "
    f"arg_min({cnpj('text')}, case when {cnpj('text')} is not null then page_number end) as cnpj, cast(sum(length(text)) as bigint) as text_length from ("
    "select a.doc_id, a.group_seq, t.page_number, t.text || case when t.page_number % 3 = 0 then ' Valor R$ ' || (t.doc_id % 1000) || ',' || lpad(cast(t.page_number % 100 as varchar), 2, '0') else '' end "
    "|| case when t.page_number % 4 = 0 then ' Vencimento: ' || dt else '' end || case when t.page_number % 5 = 0 then ' data do pagamento em ' || dt else '' end as text "
    "from assigned a join (select *, lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || '/' || lpad(cast(page_number % 12 + 1 as varchar), 2, '0') || '/2025' as dt from texts) t using (doc_id, page_number)) group by 1, 2",
    "group_pages_range": "select doc_id, group_seq, page_number from assigned",
    "merge_docs": "select f.merge_id, f.file_ord, f.doc_id, c.page_number, cast(f.off + c.page_number as bigint) as new_page from (select *, coalesce(sum(total_pages) over (partition by merge_id order by file_ord rows between unbounded preceding and 1 preceding), 0) as off from ("
    "select *, count(*) over (partition by merge_id) as files from (select cast(doc_id // 10 as bigint) as merge_id, cast(9 - doc_id % 10 as integer) as file_ord, doc_id, total_pages from sizes) where merge_id % 11 <> 5 or file_ord = 4) where files >= 2) f join corpus c using (doc_id)",
    "split_ranges": "select s.doc_id, s.part, 'pagina_' || lpad(cast(start_page as varchar), 4, '0') || '_' || lpad(cast(end_page as varchar), 4, '0') || '.pdf' as filename, c.page_number, c.page_number - s.start_page + 1 as new_page "
    "from splits s join corpus c on c.doc_id = s.doc_id and c.page_number between s.start_page and s.end_page where s.doc_id not in (select doc_id from splits where error is not null)",
    "parse_ranges": "select doc_id, part, start_page, end_page, error from splits where doc_id % 5 <> 4 union all select doc_id, 1, null, null, 'invalid_range' from sizes where doc_id % 5 = 4",
    "page_request_errors": "select 'merge' as request, merge_id as id, 'too_few_files' as error from (select cast(doc_id // 10 as bigint) as merge_id, 9 - doc_id % 10 as file_ord from sizes) "
    "where merge_id % 11 <> 5 or file_ord = 4 group by merge_id having count(*) < 2 union all select 'delete', doc_id, 'page_outside' from sizes "
    "where doc_id % 3 = 2 or (doc_id % 3 = 0 and total_pages < 3) or (doc_id % 3 = 1 and total_pages < 2) union all select 'reorder', doc_id, 'no_permutation' from sizes where doc_id % 4 = 3",
    "delete_pages": "select c.doc_id, c.page_number, cast(row_number() over (partition by c.doc_id order by c.page_number) as integer) as new_page from corpus c join sizes s using (doc_id) "
    "where (c.doc_id % 3 = 0 and s.total_pages >= 3 and c.page_number not in (1, 3)) or (c.doc_id % 3 = 1 and s.total_pages >= 2 and c.page_number <> 2)",
    "reorder_pages": "select c.doc_id, c.page_number, s.total_pages - c.page_number + 1 as new_page from corpus c join sizes s using (doc_id) where c.doc_id % 4 <> 3",
    "number_pages": "select doc_id, page_number, cast(row_number() over (partition by doc_id order by page_number) as integer) as running_number from corpus where page_number % 4 <> 2",
    "metadata_overlay": "select d.doc_id, case when l.quality = 1 then 'revisado' else 't' || d.doc_id end as title, case when l.toxic = 1 then 'moderador' else d.source end as author, d.lang as subject from documents d left join labels l using (doc_id)",
    "doc_info": "select s.doc_id, s.total_pages, 't' || s.doc_id as title, d.source as author, d.lang as subject from sizes s join documents d using (doc_id)",
    "pick_line": "select doc_id, page_number, correction_ord, line_ord, cast(score as double) as score from picked",
    "apply_text_corrections": "select l.doc_id, l.page_number, l.line_ord, coalesce(p.new_text, l.text) as text, p.new_text is not null as corrected from laid l left join ("
    "select doc_id, page_number, line_ord, arg_max(new_text, correction_ord) as new_text from picked group by 1, 2, 3) p using (doc_id, page_number, line_ord)",
    "correction_errors": "select * from (select b.doc_id, b.page_number, b.correction_ord, case when b.page_number > m.n then 'no_such_page' when b.sx0 >= b.sx1 or b.sy0 >= b.sy1 then 'empty_selection' "
    "when p.line_ord is null and (b.sx1 - b.sx0) * (b.sy1 - b.sy0) > 0.08 * 612.0 * 792.0 then 'no_text_in_large_selection' end as error from boxes b join (select doc_id, max(page_number) as n from laid group by 1) m using (doc_id) "
    "left join picked p on p.doc_id = b.doc_id and p.page_number = b.page_number and p.correction_ord = b.correction_ord) where error is not null",
    "jobs_with_email": "select w.id, w.user_id, w.filename, w.status, coalesce(p.email, '') as user_email from work w left join people p on p.id = w.user_id",
    "grants_enriched": "select g.*, coalesce(a.email, '') as user_email, coalesce(b.email, '') as granted_by_email from given g left join people a on a.id = g.user_id left join people b on b.id = g.granted_by",
    "refunds_enriched": "select g.*, coalesce(a.email, '') as user_email, coalesce(b.email, '') as requested_by_email from refund_log g left join people a on a.id = g.user_id left join people b on b.id = g.requested_by",
    "transactions_enriched": f"select b.id, b.user_id, b.amount_brl, coalesce(p.email, '') as user_email, b.package_id, b.source, coalesce(greatest(p.total_credits_mb - p.used_credits_mb, 0), 0) as user_available_mb, {invoice('b.payment_method', 'b.payment_id')} as is_invoice from bought b left join people p on p.id = b.user_id",
    "user_dashboard_join": "select p.id as user_id, p.email, w.id as job_id, w.status, w.file_size_mb from people p left join work w on w.user_id = p.id",
    "signup_upsert": "select id, email, display_name, cast(null as varchar) as avatar_url, total_credits_mb from people union all select id, arg_min(email, k), arg_min(dn, k), arg_min(av, k), 0 from (select o_custkey + case when o_orderkey % 2 = 0 then 0 else 1000000 end as id, 's' || o_orderkey || '@example.com' as email, 'n' || o_orderkey as dn, 'a' || (o_orderkey % 9) as av, o_orderkey as k from orders) where id not in (select id from people) group by id",
    "referenced_users": "select user_id from given union select granted_by from given where granted_by is not null",
    "user_dashboard": "select p.id as user_id, p.email, p.display_name, c.available_mb as available_credits_mb, p.used_credits_mb, p.total_credits_mb, p.free_uses_today, coalesce(j.n, 0) as total_jobs, coalesce(j.done, 0) as completed_jobs, cast(coalesce(j.mb, 0) as decimal(18,2)) as total_mb_processed "
    "from people p join credits c on c.user_id = p.id left join (select user_id, count(*) as n, count(*) filter (status = 'completed') as done, sum(case when status = 'completed' then file_size_mb else 0 end) as mb from work group by 1) j on j.user_id = p.id",
    "available_credits": "select * from credits",
    "simple_balance": "select id, greatest(total_credits_mb - used_credits_mb, 0) as available_mb from people",
    "paid_accounts": "select b.*, p.email, p.total_credits_mb, p.used_credits_mb, greatest(p.total_credits_mb - p.used_credits_mb, 0) as available_mb, cast(coalesce(r.mb, 0) as decimal(18,2)) as mb_processed_recent, coalesce(r.n, 0) as jobs_recent, p.total_credits_mb > p.used_credits_mb as active_paid from ("
    f"select user_id, cast(sum(credits_mb) as bigint) as credits_bought_mb, cast(sum(amount_brl) as decimal(18,2)) as amount_paid_brl, cast(sum(fee_brl) as decimal(18,2)) as fee_brl, count(*) as purchases, min(created_at) as last_at, array_to_string(list_sort(list(distinct payment_method)), ',') as methods from bought where {_PAID_FILTER} group by 1) b "
    f"join people p on p.id = b.user_id left join {_RECENT} r on r.user_id = b.user_id",
    "invoiced_accounts": "select b.*, p.email, p.total_credits_mb, p.used_credits_mb, greatest(p.total_credits_mb - p.used_credits_mb, 0) as available_mb, cast(coalesce(r.mb, 0) as decimal(18,2)) as mb_processed_recent, coalesce(r.n, 0) as jobs_recent, p.total_credits_mb > 0 and greatest(p.total_credits_mb - p.used_credits_mb, 0) * 1.0 / p.total_credits_mb <= 0.2 as low_balance from ("
    f"select user_id, cast(sum(credits_mb) as bigint) as credits_granted_mb, cast(sum(amount_brl) as decimal(18,2)) as amount_contracted_brl, count(*) as purchases, min(created_at) as last_at, coalesce(array_to_string((list(note order by created_at desc, id desc) filter (note is not null))[1:3], '|'), '') as notes from bought where {invoice('payment_method', 'payment_id')} group by 1) b "
    f"join people p on p.id = b.user_id left join {_RECENT} r on r.user_id = b.user_id",
    "finance_summary": f"select cast(sum(amount_brl) filter (paidx) as decimal(18,2)) as gross_paid_brl, cast(sum(fee_brl) filter (paidx) as decimal(18,2)) as fees_brl, cast(sum(amount_brl) filter (paidx) - sum(fee_brl) filter (paidx) as decimal(18,2)) as net_paid_brl, cast(sum(refunded_amount_brl) filter (paidx) as decimal(18,2)) as refunded_brl, "
    "cast(sum(credits_mb) filter (inv) as bigint) as invoice_credits_mb, cast(sum(credits_mb) filter (paidx) as bigint) as paid_credits_mb, count(distinct user_id) filter (inv) as invoiced_accounts, count(distinct user_id) filter (paidx) as paid_accounts, count(distinct user_id) filter (paidx and av > 0) as active_paid_accounts, "
    f"count(distinct user_id) filter (inv and tot > 0 and av * 5 <= tot) as low_balance_invoiced from (select b.*, {invoice('payment_method', 'payment_id')} as inv, {_PAID_FILTER} as paidx, greatest(p.total_credits_mb - p.used_credits_mb, 0) as av, p.total_credits_mb as tot from bought b join people p on p.id = b.user_id)",
    "credits_in_circulation": "select cast(sum(greatest(total_credits_mb - used_credits_mb, 0)) as bigint) as credits_in_circulation_mb from people where role <> 'admin'",
    "recent_usage_by_user": "select user_id, cast(sum(file_size_mb) as decimal(18,2)) as mb_processed_recent, count(*) as jobs_recent from work group by 1",
    "ip_daily_usage": "select * from used_ip",
    "job_summary": "select user_id, count(*) filter (status = 'completed') as completed_jobs, count(*) as total_jobs from (select * from work qualify row_number() over (partition by user_id order by created_at desc, id desc) <= 10) group by 1",
    "ocr_coverage": "select doc_id, count(*) as total_pages, count(native_text) as native_pages, count(*) filter (coalesce(length(native_text), 0) < 50) as needs_ocr_pages, count(ocr_text) as ocr_pages, count(*) filter (native_text is null and ocr_text is null) as empty_pages from corpus group by 1",
    "last_jobs_per_user": "select user_id, array_to_string(list(filename || ':' || status order by created_at desc, id desc)[1:3], ',') as last_jobs from work group by 1",
    "users_search": "select id, email, role, greatest(total_credits_mb - used_credits_mb, 0) as available_mb, created_at from people where contains(email, '0009') order by created_at desc, id desc limit 100",
    "recent_grants": "select g.*, coalesce(a.email, '') as user_email, coalesce(b.email, '') as granted_by_email from (select * from given order by created_at desc, id desc limit 40) g left join people a on a.id = g.user_id left join people b on b.id = g.granted_by",
    "ip_usage_today": "select * from used_ip where usage_date = date '2024-01-30' order by updated_at desc, ip desc limit 40",
    "admin_logs": "select part, ref, user_email from (select 'job' as part, cast(w.id as varchar) as ref, coalesce(p.email, '') as user_email from (select * from work order by created_at desc, id desc limit 100) w left join people p on p.id = w.user_id) union all "
    "(select 'failed', cast(w.id as varchar), coalesce(p.email, '') from (select * from work order by created_at desc, id desc limit 100) w left join people p on p.id = w.user_id where status = 'failed' order by w.created_at desc, w.id desc limit 20) union all "
    "select 'grant', cast(g.id as varchar), coalesce(p.email, '') from (select * from given order by created_at desc, id desc limit 30) g left join people p on p.id = g.user_id union all "
    "(select 'ip', ip, last_email from used_ip where usage_date = date '2024-01-30' order by updated_at desc, ip desc limit 40)",
    "transactions_search": "select b.id, b.payment_id, coalesce(p.email, '') as user_email, b.created_at from (select * from bought order by created_at desc, id desc limit 100) b left join people p on p.id = b.user_id where contains(lower(coalesce(p.email, '')), 'invoice_') or contains(lower(b.payment_id), 'invoice_')",
    "job_history": "select user_id, cast(row_number() over (partition by user_id order by created_at desc, id desc) as integer) as rank, id, filename, status from work qualify row_number() over (partition by user_id order by created_at desc, id desc) <= 10",
    "blog_list": "(select 'public' as part, post_id, slug from posts where published order by published_at desc, post_id limit 50) union all (select 'drafts', post_id, slug from posts order by updated_at desc, post_id limit 100)",
    "accounts_order": f"select id as user_id, total_credits_mb > used_credits_mb as active_paid, greatest(total_credits_mb - used_credits_mb, 0) as available_mb, email from people where id in (select user_id from bought where {_PAID_FILTER})",
    "row_scope": "select 'job' as part, id, user_id from work where user_id = 42 union all select 'transaction', id, user_id from bought where user_id = 42 union all select 'user', id, id from people where id = 42",
    "counter_as_of": f"select id, {counter('free_uses_today', 'last_free_use')} as free_uses_today, {counter('pdf_tools_uses_today', 'pdf_tools_last_use')} as pdf_tools_uses_today from people",
    "consume_credits": "select id, user_id, created_at, file_size_mb, before as balance_before, ok as accepted, before - after as charged_mb from spending",
    "running_balance": "select p.id as user_id, p.used_credits_mb + coalesce(s.n, 0) as used_credits_mb from people p left join (select user_id, cast(sum(before - after) as bigint) as n from spending group by 1) s on s.user_id = p.id",
    "admission": "select * from admitted",
    "admission_replay": "select r.id, r.user_id, r.ip, r.file_size_mb, r.pages_count, case when r.admin then 'admin' when r.by_credits then 'credits' else d.mode end as mode from (select * from replay0) r left join (select id, mode from day_walk where id is not null) d on d.id = r.id",
    "charge": "select id, user_id, mode, cast(case when mode = 'credits' then file_size_mb else 0 end as decimal(10,2)) as charged_mb, case when mode = 'free' then 1 else 0 end as free_uses, case when mode = 'free' and ip is not null then 1 else 0 end as ip_free_uses from admitted where mode in ('admin', 'credits', 'free')",
    "tool_replay": "select r.id, r.user_id, r.ip, case when r.unlimited then 'unlimited' else d.mode end as mode from tools r left join (select id, mode from tool_walk where id is not null) d on d.id = r.id",
    "tool_quota": "select user_id, is_admin or has_credits as unlimited, has_credits, is_admin, cast(case when is_admin or has_credits then 0 else used end as bigint) as used_today, case when not (is_admin or has_credits) then 2 end as daily_limit, cast(case when not (is_admin or has_credits) then greatest(2 - used, 0) end as bigint) as remaining from ("
    f"select p.id as user_id, p.role = 'admin' as is_admin, case when p.id % 2 = 0 then s.available_mb else 0 end > 0 as has_credits, greatest({counter('p.pdf_tools_uses_today', 'p.pdf_tools_last_use')}, coalesce(i.tool_use_count, 0)) as used from people p join spend s on s.user_id = p.id "
    f"left join (select user_id, {usable('ip_address')} as ip from (select user_id, arg_max(ip_address, (created_at, id)) as ip_address from work group by 1)) a on a.user_id = p.id left join used_ip i on i.ip = a.ip and i.usage_date = date '2024-01-30')",
    "grant_credits": f"select 'transaction' as part, 'invoice_' || request_id as ref, user_id, cast(credits_mb as bigint) as credits_mb, {LEDGER_AS_OF} + to_days(days_valid) as expires_at from {_GRANT_MATCH} union all "
    f"select 'grant', coalesce(note, '-'), user_id, credits_mb, null from {_GRANT_MATCH} union all "
    f"select 'balance', cast(greatest(max(total_credits_mb) + sum(credits_mb) - max(used_credits_mb), 0) as bigint)::varchar, user_id, max(total_credits_mb) + cast(sum(credits_mb) as bigint), null from {_GRANT_MATCH} group by user_id union all "
    f"select 'rejected', request_id || case when {_GRANT_OK} then ':unknown_user' else ':invalid' end, null, null, null from {_GRANT_REQ} where not ({_GRANT_OK}) or lower(trim(email)) not in (select email from people)",
    "signup_role_backfill": "select id, case when email = 'customer#000000033@example.com' then 'admin' else role end as role from people",
    "net_amount_backfill": f"select id, coalesce(net_amount_brl, cast(greatest(amount_brl - fee_brl, 0) as {CENT})) as net_amount_brl from bought",
    "publish_state": "select * from posts",
    "notification_id": "select o_orderkey as notice_id, case when o_orderkey % 7 in (0, 2, 3, 4, 5) then cast(o_orderkey as varchar) end as payment_id from orders",
    "payment_parse": "select payment_id, ts, status, user_id, package_id, credits_mb, payment_method from paid",
    "payment_fee": f"select payment_id, ts, amount_brl, fee_brl, cast(greatest(amount_brl - fee_brl, 0) as {CENT}) as net_amount_brl from paid",
    "fulfil_payments": "select * from fulfilled",
    "unmatched_payments": "select payment_id, status, ts, 'missing_user_id' as error from paid where user_id is null",
    "user_balances": "select user_id, greatest(cast(sum(d) as bigint), 0) as total_credits_mb from (select cast(user_id as bigint) as user_id, credited_mb as d from fulfilled union all select user_id, credits_mb from given union all select user_id, -credits_mb from refund_log) group by 1",
    "method_deducts_fee": f"select id, {deducts('payment_method', 'case when id % 5 = 0 then ' + chr(39) + 'debit_card' + chr(39) + ' when id % 5 = 1 then ' + chr(39) + 'bank' + chr(39) + ' end')} as deducts from bought",
    "is_invoice": f"select id, {invoice('m', 'payment_id')} as invoice, lower(m) in {text_in(V.PREVIEW_INVOICE_METHODS)} or starts_with(payment_id, 'invoice_') as preview_invoice from (select *, case when id % 9 = 0 then 'Faturado' else payment_method end as m from bought)",
    "refund_preview": f"select id as transaction_id, user_id, payment_id, method as payment_method, amount_brl, fee as fee_brl, deduct_fee, refunded_amount_brl as already_refunded_amount_brl, refunded_credits_mb as already_refunded_credits_mb, available_mb, credits_mb, claw as credits_to_claw_mb, "
    f"cast(case when inv then 0 else money end as {CENT}) as refund_amount_brl, inv as is_invoice, not inv and money > 0 as mp_money_refund, rs = '' as can_refund, rs as block_reasons from (select *, concat_ws(' ', r1, r2, case when claw <= 0 then '{V.REASON_NO_CREDITS}' end, case when not inv and money <= 0 then '{V.REASON_NO_MONEY}' end, r5) as rs from preview)",
    "refund_apply": f"select id as request_id, id as transaction_id, user_id, cast(claw as bigint) as credits_clawed_mb, m as refund_amount_brl, case when refunded_credits_mb + claw >= credits_mb then 'refunded' else 'partially_refunded' end as payment_status, cast(refunded_amount_brl + m as {CENT}) as refunded_amount_brl, "
    f"cast(refunded_credits_mb + claw as bigint) as refunded_credits_mb, fee as fee_brl, cast(amount_brl - fee as {CENT}) as net_amount_brl, cast(rest as bigint) as user_available_mb from (select t.*, w.claw, w.rest, cast(case when inv then 0 when w.claw = pack_left then max_money else {refund_share('w.claw')} end as {CENT}) as m "
    "from refund_walk w join terms t on t.id = w.id where w.ok)",
    "refund_refusals": "select o_orderkey as request_id, o_orderkey as transaction_id, case when p.id is null then 'unknown_transaction' when rs <> '' then rs else 'balance_spent_in_batch' end as block_reasons "
    f"from orders left join (select id, concat_ws(' ', r1, r2, case when claw <= 0 then '{V.REASON_NO_CREDITS}' end, case when not inv and money <= 0 then '{V.REASON_NO_MONEY}' end, r5) as rs from preview) p on p.id = o_orderkey "
    "where o_orderkey not in (select id from refund_walk where ok and id is not null)",
    "constraint_checks": "select 'users_credits_valid' as check_name, count(*) as violations from people where used_credits_mb < 0 or used_credits_mb > total_credits_mb union all select 'users_role_known', count(*) from people where role not in ('user', 'admin') union all select 'users_email_present', count(*) from people where email is null "
    "union all select 'transactions_amount_not_negative', count(*) from bought where amount_brl < 0 union all select 'transactions_credits_positive', count(*) from bought where credits_mb <= 0 union all select 'jobs_size_positive', count(*) from work where file_size_mb <= 0 union all select 'jobs_pages_positive', count(*) from work where pages_count <= 0 "
    "union all select 'grants_credits_positive', count(*) from given where credits_mb <= 0 union all select 'grants_amount_not_negative', count(*) from given where amount_brl < 0 union all select 'users_email_unique', count(*) - count(distinct email) from people union all select 'transactions_payment_id_unique', count(*) - count(distinct payment_id) from bought "
    "union all select 'ip_usage_key_unique', count(*) - count(distinct (ip, usage_date)) from used_ip union all select 'posts_slug_unique', count(slug) - count(distinct slug) from posts union all select 'transactions_user_known', count(*) from bought where user_id not in (select id from people) union all select 'jobs_user_known', count(*) from work where user_id not in (select id from people) "
    "union all select 'grants_user_known', count(*) from given where user_id not in (select id from people) union all select 'refunds_user_known', count(*) from refund_log where user_id not in (select id from people) union all select 'refunds_transaction_known', count(*) from refund_log where transaction_id not in (select id from bought)",
    "stream_fulfil": "select * from fulfilled",
    "stream_ip_usage": "select * from used_ip",
    "stream_job_state": "",
    "stream_classify": "",
}
BODIES["stream_job_state"] = BODIES["job_ledger"]


def reference_sql() -> dict[str, str]:
    made = {name: statement(body) for name, body in BODIES.items() if body}
    # The stream carries no OCR text.
    made["stream_classify"] = made["classify_pages"].replace(
        f"({VIEWS['corpus']})", "(select *, cast(null as varchar) as ocr_text from corpus0)"
    )
    return made
