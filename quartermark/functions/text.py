"""Text functions as Column expressions; NFKD and difflib alone need Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subject keywords by document type; the first type that matches wins.
SUBJECT_KEYWORDS = (
    ("earnings_call", ("transcript", "con call", "concall", "conference call", "earnings call")),
    ("investor_presentation", ("investor presentation", "analyst presentation", "investor/analyst presentation", "investor call presentation", "earnings presentation")),
    ("annual_report", ("annual report",)),
    ("press_release", ("financial results", "un-audited financial", "unaudited financial", "audited financial", "results for the quarter", "outcome of board meeting", "press release", "financial result")),
    ("management_commentary", ("credit rating", "clarification", "newspaper publication", "intimation", "outcome of the meeting")),
)
DEFAULT_DOC_TYPES = ("earnings_call", "press_release", "investor_presentation", "annual_report")
DOC_TYPE_PRIORITY = ("earnings_call", "investor_presentation", "press_release", "annual_report", "management_commentary")

# Section patterns, the first that is found wins.
SECTIONS = (
    (r"\b(prepared remarks?|opening remarks?|management discussion)\b", "prepared_remarks"),
    (r"\b(question[s]? and answer|q&a|question[s]? from|operator:.*question)\b", "qa_session"),
    (r"\b(financial results?|financial highlights?|revenue|earnings per share|net income)\b", "financial_results"),
    (r"\b(guidance|outlook|forecast|expect.*quarter|full[- ]year.*expect)\b", "guidance"),
    (r"\b(risk factors?|risk[s]? include|material risk)\b", "risk_factors"),
    (r"\b(strategy|strategic|long[- ]term|roadmap|priorities)\b", "strategy"),
    (r"\b(market|industry|macro|economic environment|sector)\b", "market_overview"),
)
# Typographic characters and what they are read as, character by character.
TYPOGRAPHY_FROM = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u2033\u2013\u2014\u2212\u2010\u00a0\u2009\u202f"
TYPOGRAPHY_TO = "''''\"\"\"\"----   "


def classify(subject: Column, allowed=DEFAULT_DOC_TYPES) -> Column:
    """Document type of an announcement's subject, or null."""
    s, out = F.lower(subject), F.lit(None).cast("string")
    for kind, words in reversed(SUBJECT_KEYWORDS):
        if kind in allowed:
            hit = F.lit(False)
            for w in words:
                hit = hit | s.contains(w)
            out = F.when(hit, kind).otherwise(out)
    return out


def type_priority(doc_type: Column) -> Column:
    out = F.lit(len(DOC_TYPE_PRIORITY))
    for i, kind in reversed(list(enumerate(DOC_TYPE_PRIORITY))):
        out = F.when(doc_type == kind, i).otherwise(out)
    return out


def section(text: Column) -> Column:
    out = F.lit("unknown")
    for pattern, name in reversed(SECTIONS):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def md5_id(*parts: Column) -> Column:
    """First 16 hex digits of md5 over the parts joined by '::'."""
    return F.substring(F.md5(F.concat_ws("::", *[p.cast("string") for p in parts]).cast("binary")), 1, 16)


def sha_key(text: Column, size: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, size)


def natural_key(prefix: str, ticker: Column, quarter: Column, year: Column) -> Column:
    unknown = F.lit("unknown")
    return F.concat_ws("::", F.lit(prefix), F.coalesce(ticker, unknown), F.coalesce(quarter, unknown), F.coalesce(year.cast("string"), unknown))


def squash(text: Column) -> Column:
    """Lower case, white space runs to one space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize_quote(text: Column, compatibility: bool = True) -> Column:
    """The one definition of 'verbatim': typography and case do not count, wording does.

    ``compatibility`` folds ligatures and accents by NFKD first, in a pandas UDF; without
    it the function is JVM-only.
    """
    s = F.coalesce(text, F.lit(""))
    if compatibility:
        s = F.pandas_udf(_nfkd, "string")(s)
    s = F.regexp_replace(F.translate(s, TYPOGRAPHY_FROM, TYPOGRAPHY_TO), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(F.trim(s), r"""^["']+|["']+$""", ""))


def _nfkd(texts):
    return texts.str.normalize("NFKD")


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def citation_quote(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters, cut back to a space and marked with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")


def pretty_label(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Words by which a company's name or ticker tells its sector; the first sector (in order) one of whose words occurs wins.
SECTORS = (
    ("banking_nbfc", (
        "bank", "banking", "finance", "financial services", "nbfc", "housing finance",
        "hdfc", "icici", "kotak", "axis", "sbi", "bajaj finance", "bajaj finserv",
        "chola", "cholamandalam", "shriram", "muthoot", "mannapuram", "pnb", "canara",
        "indusind", "yes bank", "idfc", "au small finance", "bandhan",
    )),
    ("it_services", (
        "infosys", "tcs", "tata consultancy", "wipro", "hcl", "tech mahindra",
        "ltimindtree", "mindtree", "mphasis", "persistent", "coforge", "cyient",
        "technologies", "information technology", "it services", "software",
    )),
    ("pharma_healthcare", (
        "pharma", "pharmaceutical", "labs", "laboratories", "healthcare", "sun pharma",
        "cipla", "dr reddy", "divi's", "divis", "lupin", "aurobindo", "biocon", "hospital",
        "torrent pharma", "zydus", "apollo hospitals", "fortis",
    )),
    ("fmcg_consumer", (
        "hindustan unilever", "hul", "itc", "nestle", "britannia", "dabur", "marico",
        "godrej consumer", "colgate", "tata consumer", "varun beverages", "united spirits",
        "consumer goods", "fmcg",
    )),
    ("auto_ancillary", (
        "maruti", "tata motors", "mahindra", "bajaj auto", "hero motocorp", "eicher",
        "tvs motor", "ashok leyland", "motherson", "bosch", "exide", "amara raja",
        "motors", "automobile", "auto ancillary",
    )),
    ("metals_cement", (
        "tata steel", "jsw steel", "hindalco", "vedanta", "sail", "nmdc", "coal india",
        "ultratech", "ambuja", "acc", "shree cement", "jk cement", "steel", "cement", "mining",
    )),
    ("energy_power", (
        "reliance industries", "ongc", "oil india", "bpcl", "hpcl", "iocl", "gail",
        "ntpc", "power grid", "tata power", "adani power", "adani green", "adani energy",
        "jsw energy", "power", "energy", "oil", "gas", "refinery",
    )),
    ("telecom", ("bharti airtel", "reliance jio", "vodafone idea", "vi ", "telecom", "airtel")),
    ("infra_capital_goods", (
        "larsen", "l&t", "adani ports", "adani enterprises", "irb infra", "gmr",
        "siemens", "abb india", "cummins india", "bhel", "capital goods", "infrastructure",
        "engineering construction",
    )),
    ("real_estate", ("dlf", "godrej properties", "oberoi realty", "prestige estates", "sobha", "real estate", "realty")),
)


def sector(name: Column, sectors=SECTORS, default: str = "general") -> Column:
    s, out = F.lower(name), F.lit(default)
    for label, words in reversed(sectors):
        hit = F.lit(False)
        for w in words:
            hit = hit | s.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out
