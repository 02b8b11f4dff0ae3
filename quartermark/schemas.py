"""Declared schemas and closed vocabularies."""

from __future__ import annotations

CITATION = "struct<chunk_id:string,doc_type:string,quarter:string,source_url:string,speaker:string,quote:string,relevance:double>"
LEDGER_ITEM = "struct<label:string,delta:double,detail:string,evidence:string>"

#: Fields of a theme, a risk and a guidance item within a signal's row.
THEME = {"theme": "string", "status": "string", "cur": "int", "prev": "int", "sentiment": "double", "prev_sentiment": "double", "key_quotes": "array<string>", "count_change": "int", "sentiment_change": "double"}
RISK = {"risk": "string", "severity": "string", "status": "string", "cur": "int", "prev": "int", "key_quotes": "array<string>"}
GUIDANCE_ITEM = {"metric": "string", "period": "string", "guided_in": "string", "guidance": "string", "actual": "string", "outcome": "string", "miss_reason": "string"}


def struct_of(fields: dict[str, str]) -> str:
    return f"struct<{','.join(f'{n}:{kind}' for n, kind in fields.items())}>"


SIGNAL_KEY = "id string, ticker string, company string, quarter string, fiscal_year int, generated_at timestamp_ntz"

#: Stored signal tables by kind: the key columns above, then these.
SIGNALS = {
    "confidence": "score double, previous_score double, tone_label string, sub_dimensions array<double>, reliability string, summary string, "
    f"drivers array<string>, citations array<{CITATION}>",
    "narrative": f"overall_shift string, summary string, themes array<{struct_of(THEME)}>, prior_available boolean, "
    f"accelerating array<string>, emerging array<string>, fading array<string>, newly_risky array<string>, citations array<{CITATION}>",
    "guidance": "score double, previous_score double, beats int, misses int, in_line int, withdrawals int, beat_rate double, serial_miss_risk boolean, tracked int, reliability string, "
    f"guidance_items array<{struct_of(GUIDANCE_ITEM)}>, recent_pattern array<string>, summary string, citations array<{CITATION}>",
    "risk": f"direction string, summary string, risks array<{struct_of(RISK)}>, "
    f"new_risks array<string>, escalating array<string>, diminishing array<string>, citations array<{CITATION}>",
}
DOCUMENT = "doc_id string, ticker string, company string, doc_type string, quarter string, fiscal_year int, event_date timestamp_ntz, source_url string, title string, raw_text string, ingested_at timestamp_ntz"
CHUNK = "chunk_id string, doc_id string, ticker string, company string, doc_type string, section string, quarter string, fiscal_year int, event_date timestamp_ntz, speaker string, is_management boolean, text string, char_start int, source_url string, title string"
RUN = "id string, ticker string, quarter string, fiscal_year int, fingerprint string, scored_at timestamp_ntz"
MANIFEST = "id string, signal_type string, ticker string, quarter string, fiscal_year int, manifest string, generated_at timestamp_ntz"
ANNOUNCEMENT = "source string, subject string, urls array<string>, event_date timestamp_ntz"

# Vocabularies.
DOC_TYPES = ("earnings_call", "annual_report", "investor_presentation", "press_release", "broker_note", "news_article", "management_commentary")
THEME_STATUS = ("accelerating", "emerging", "fading", "stable", "newly_risky")
SEVERITIES = ("low", "medium", "high", "critical")
RISK_STATUS = ("newly_material", "escalating", "diminishing", "stable", "resolved")
OUTCOMES = ("beat", "miss", "in_line", "withdrew", "pending")


def table_schema(kind: str) -> str:
    return f"{SIGNAL_KEY}, {SIGNALS[kind]}"


#: The version of the stored tables' schemas. 1 had no fields for changes in a theme, no ``tracked`` and ``reliability`` of
#: guidance, no ``prior_available``, and keys of signals under short prefixes.
VERSION = 2
_OLD_THEME = {k: v for k, v in THEME.items() if k not in ("count_change", "sentiment_change")}
SHORT_PREFIX = {"confidence": "conf", "narrative": "narr", "guidance": "guid", "risk": "risk"}


def declared(table: str, version: int, now: str) -> str:
    """The schema that rows of ``version`` were written with."""
    if version >= VERSION:
        return now
    for new in (", tracked int, reliability string", ", prior_available boolean"):
        if table in ("guidance_signals", "narrative_signals"):
            now = now.replace(new, "")
    return now.replace(struct_of(THEME), struct_of(_OLD_THEME))


def upgrade(table: str, version: int, rows):
    """Rows of an older version as those of the present one; applying it again changes nothing."""
    from pyspark.sql import functions as F

    if version >= VERSION:
        return rows
    kind = table.removesuffix("_signals")
    if kind in SHORT_PREFIX:
        rows = rows.withColumn("id", F.regexp_replace("id", f"^{SHORT_PREFIX[kind]}::", f"{kind}::"))
    if kind == "guidance":
        rows = rows.withColumns({"tracked": F.col("beats") + F.col("misses") + F.col("in_line"), "reliability": F.lit(None).cast("string")})
    if kind == "narrative":
        def whole(t):
            changes = [(t["cur"] - t["prev"]).alias("count_change"), F.round(t["sentiment"] - t["prev_sentiment"], 3).alias("sentiment_change")]
            return F.struct(*[t[n].alias(n) for n in _OLD_THEME], *changes)

        rows = rows.withColumns({"themes": F.transform("themes", whole), "prior_available": F.lit(None).cast("boolean")})
    return rows
