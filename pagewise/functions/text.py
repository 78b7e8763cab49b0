"""Text expressions over page columns. All of them stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewise.functions import values as V

# Whitespace as Unicode defines it plus the four ASCII separators, for trimming and splitting.
_SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Runs that are not already one plain space.
_ASCII_SPACE_RUN = r" *[\t-\r\x1c-\x1f][\s\x1c-\x1f]*|  +"

# Blocks whose characters may decompose to ASCII in Latin-script text: Latin-1 to Extended-B,
# Latin Extended Additional, punctuation, super- and subscripts, letter-like, ligatures, full width.
_FOLD_BLOCKS = ((0x80, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2150), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


def _ascii_residue(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")


def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Single-letter map for ``translate`` and the few characters that become several letters."""
    source, target, several = [], [], []
    for low, high in _FOLD_BLOCKS:
        for code in range(low, high):
            residue = _ascii_residue(chr(code))
            if len(residue) == 1:
                source.append(chr(code))
                target.append(residue)
            elif len(residue) > 1:
                several.append((chr(code), residue))
    return "".join(source), "".join(target), tuple(several)


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _fold_tables()


def strip_text(text: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(text, F.lit(_SPACES))


def clean_page_text(text: Column) -> Column:
    """Stripped page text, null when nothing is left."""
    return F.nullif(strip_text(text), F.lit(""))


def best_text(ocr_text: Column, native_text: Column) -> Column:
    """OCR text first, then native text, then the empty string."""
    return F.coalesce(F.nullif(ocr_text, F.lit("")), F.nullif(native_text, F.lit("")), F.lit(""))


def needs_ocr(native_text: Column, minimum: int = V.MIN_NATIVE_TEXT_LENGTH) -> Column:
    return F.coalesce(F.length(native_text), F.lit(0)) < minimum


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold_letters(text: Column) -> Column:
    """Replace every character that stands for one ASCII letter; ASCII text passes untouched."""
    return F.when(_is_ascii(text), text).otherwise(F.translate(text, FOLD_FROM, FOLD_TO))


def drop_rest(letters: Column) -> Column:
    """Spell out ligatures and the like, then drop what is still outside ASCII."""
    pairs = F.expr("array(" + ", ".join(f"struct('{c}' AS c, '{r}' AS r)" for c, r in FOLD_SEVERAL) + ")")
    spelled = F.aggregate(pairs, letters, lambda text, pair: F.replace(text, pair["c"], pair["r"]))
    return F.when(_is_ascii(letters), letters).otherwise(F.regexp_replace(spelled, r"[^\x00-\x7F]+", ""))


def fold_ascii(text: Column) -> Column:
    """Drop accents and everything else outside ASCII."""
    return drop_rest(fold_letters(text))


def squeeze(folded: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(folded, _ASCII_SPACE_RUN, " "))


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return squeeze(fold_ascii(F.lower(text)))


def text_hash(norm: Column) -> Column:
    return F.sha2(norm, 256)


def extract_cnpj(text: Column) -> Column:
    """First tax id (14 digits, not all zero); also found inside longer digit runs."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(V.CNPJ_PATTERN), F.lit(1)), lambda hit: F.regexp_replace(hit, r"\D", "")
    )
    return F.get(F.filter(found, lambda digits: digits != "0" * 14), F.lit(0))


def cnpj_base(cnpj: Column) -> Column:
    digits = F.regexp_replace(cnpj, r"\D", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8))


def _marker(norm: Column, pattern: str) -> Column:
    """``struct(current, total)`` of the first hit of one marker pattern, null when out of range."""
    current = F.regexp_extract(norm, pattern, 1).try_cast("int")
    total = F.regexp_extract(norm, pattern, 2).try_cast("int")
    return F.when(
        (current >= 1) & (current <= total) & (total <= V.MAX_PAGE_MARKER),
        F.struct(current.alias("current"), total.alias("total")),
    )


def page_x_of_y(norm: Column) -> Column:
    """Page marker such as ``2 de 3``; a pattern whose first hit is out of range gives way to the next.

    All three patterns need digits around ``de`` or ``/``; one cheap scan for that spares most pages the rest.
    """
    markers = F.coalesce(*[_marker(norm, pattern) for pattern in V.PAGE_MARKER_PATTERNS])
    return F.when(norm.rlike(r"[0-9]\s*(?:de|/)\s*[0-9]"), markers)


def is_continuation(norm: Column) -> Column:
    return norm.contains(V.CONTINUATION_WORD) | F.coalesce(page_x_of_y(norm)["current"] >= 2, F.lit(False))


def looks_like_spreadsheet(text: Column) -> Column:
    """Long text made mostly of one- and two-letter tokens."""

    def mostly_short(tokens: Column) -> Column:
        short = F.size(F.filter(tokens, lambda token: F.length(token) <= 2))
        return (F.size(tokens) >= V.SPREADSHEET_MIN_TOKENS) & (
            short / F.size(tokens) > V.SPREADSHEET_SHORT_SHARE
        )

    # The one-element array lets the tokens be computed once and used three times.
    split = F.array(F.split(strip_text(text), _SPACE_CLASS + "+"))
    long_enough = F.coalesce(F.length(text), F.lit(0)) >= V.SPREADSHEET_MIN_LENGTH
    return F.when(long_enough, F.exists(split, mostly_short)).otherwise(False)


def extract_supplier(text: Column, pattern: str | None) -> Column:
    """First capture of ``pattern``; null when it is missing, invalid or captures nothing."""
    try:
        usable = bool(pattern) and re.compile(pattern).groups > 0
    except re.error:
        usable = False
    if not usable:
        return F.lit(None).cast("string")
    # i, m, s as usual; d keeps $ on \n only; U makes \s and case folding follow Unicode.
    captured = F.regexp_extract(text, "(?imsdU)" + pattern, 1)
    name = F.btrim(F.regexp_replace(strip_text(captured), _SPACE_CLASS + "+", " "), F.lit(" :-"))
    return F.nullif(name, F.lit(""))


def clean_supplier(supplier: Column) -> Column:
    """Trim punctuation, cut long names at a word border, drop names under three letters."""
    name = F.btrim(F.regexp_replace(supplier, _SPACE_CLASS + "+", " "), F.lit(" :-.,"))
    cut = F.when(F.length(name) > 60, F.regexp_replace(F.substring(name, 1, 60), " [^ ]*$", "")).otherwise(name)
    return F.when(F.length(cut) >= 3, cut)


def norm_supplier(name: Column) -> Column:
    squeezed = F.btrim(F.regexp_replace(F.lower(name), _SPACE_CLASS + "+", " "))
    return F.nullif(squeezed, F.lit(""))


def suppliers_compatible(name_a: Column, cnpj_a: Column, name_b: Column, cnpj_b: Column) -> Column:
    """Same tax-id root, or names equal or contained, or one of the names missing."""
    a, b = norm_supplier(name_a), norm_supplier(name_b)
    same_root = F.coalesce(cnpj_base(cnpj_a) == cnpj_base(cnpj_b), F.lit(False))
    return same_root | F.coalesce(a.contains(b) | b.contains(a), F.lit(True))


def slugify(text: Column) -> Column:
    """File-name slug; an empty result reads ``desconhecido``."""
    slug = F.btrim(F.regexp_replace(fold_ascii(F.lower(text)), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(V.UNKNOWN))


def blog_slug(text: Column, as_of: Column) -> Column:
    """Post slug of at most 80 characters; hyphens are trimmed before the cut."""
    letters = F.translate(F.lower(strip_text(text)), V.SLUG_ACCENTS_FROM, V.SLUG_ACCENTS_TO)
    kept = F.regexp_replace(letters, f"[^a-z0-9{_SPACE_CLASS[1:-1]}-]", "")
    joined = F.btrim(F.regexp_replace(kept, f"[{_SPACE_CLASS[1:-1]}_-]+", "-"), F.lit("-"))
    stamp = F.unix_timestamp(as_of.cast("timestamp")).cast("string")
    return F.coalesce(F.nullif(F.substring(joined, 1, 80), F.lit("")), F.concat(F.lit("post-"), stamp))


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2))))), ""
    )


def doc_type_label(doc_type: Column) -> Column:
    known = F.create_map(*[F.lit(part) for pair in V.DOC_TYPE_LABELS.items() for part in pair])
    return F.coalesce(F.try_element_at(known, doc_type), title_case(F.replace(doc_type, F.lit("_"), F.lit(" "))))


def is_viasat(doc_type: Column, supplier: Column, matched_pattern: Column) -> Column:
    """Satellite bill by type, or by its name in the supplier or in the matched pattern."""
    return (doc_type == V.SATELLITE_TYPE) | F.lower(F.concat_ws(" ", supplier, matched_pattern)).contains(
        V.SATELLITE_WORD
    )


def usable_ip(ip: Column) -> Column:
    """Lower-cased address, null for local and private ones."""
    value = F.lower(strip_text(ip))
    private = F.lit(False)
    for prefix in V.PRIVATE_PREFIXES:
        private = private | value.startswith(prefix)
    return F.when(~((value == "") | value.isin(*V.LOCAL_ADDRESSES) | private), value)


def client_ip(proxy_header: Column, forwarded_header: Column, peer_host: Column) -> Column:
    """First address of the proxy headers, else the peer, else ``unknown``."""
    header = F.coalesce(F.nullif(proxy_header, F.lit("")), F.nullif(forwarded_header, F.lit("")))
    return F.coalesce(strip_text(F.split_part(header, F.lit(","), F.lit(1))), peer_host, F.lit("unknown"))


def is_admin(role: Column, email: Column, admin_emails: tuple[str, ...] = ()) -> Column:
    by_role = F.coalesce(F.lower(role) == "admin", F.lit(False))
    if not admin_emails:
        return by_role
    address = F.lower(strip_text(F.coalesce(email, F.lit(""))))
    return by_role | address.isin(*[item.strip().lower() for item in admin_emails])


def request_excerpt(text: Column) -> Column:
    """Beginning of the stripped text; white space the cut ends on stays."""
    return F.substring(strip_text(F.coalesce(text, F.lit(""))), 1, V.EXCERPT_LENGTH)


def page_request_text(page_number: Column, excerpt: Column, previous_type: Column, previous_supplier: Column) -> Column:
    """Request body for the fallback model: ``request_excerpt`` plus what the previous page turned out to be."""
    none = F.lit(V.NO_PREVIOUS)
    return F.concat(
        F.lit("Texto extraído da página "),
        page_number.cast("string"),
        F.lit(':\n"""\n'),
        excerpt,
        F.lit('\n"""\n\nTipo de documento da página anterior (se houver): '),
        F.coalesce(F.nullif(previous_type, F.lit("")), none),
        F.lit("\nFornecedor da página anterior (se houver): "),
        F.coalesce(F.nullif(previous_supplier, F.lit("")), none),
        F.lit("\n"),
    )
