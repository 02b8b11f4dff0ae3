"""What each signal asks for: retrieval specifications, prompts and the shapes of the answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """Standing queries and metadata filters of one signal's evidence."""

    queries: tuple[str, ...]
    k: int
    doc_types: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    management_only: bool = False
    many_periods: bool = False
    answer: str = ""
    task: str = field(default="", repr=False)


QUOTE = "struct<chunk_id:string,quote:string>"
SPECS = {
    "confidence": Spec(
        ("management certainty about the outlook", "caveats and conditions on results", "defensive answers to questions", "record or best performance claims", "range of the guidance given", "questions left without an answer"),
        6, doc_types=("earnings_call", "press_release", "investor_presentation"), management_only=True,
        answer=f"struct<management_statements:array<struct<chunk_id:string,quote:string,tone:string>>,hedging_markers:array<{QUOTE}>,defensive_terms:array<{QUOTE}>,superlative_terms:array<{QUOTE}>,wide_guidance:boolean,topic_avoidance:boolean>",
        task="List statements by management with their tone, hedges, defensive and superlative terms, each with the words as they stand.",
    ),
    "narrative": Spec(
        ("demand and growth", "costs, prices and margins", "regulation and competition", "use of cash", "rates, inflation and currency", "rural and urban demand"),
        5, answer="struct<themes:array<struct<theme:string,evidence_count_current:int,sentiment_current:double,interpretation:string,key_quotes:array<string>>>,shift_summary:string>",
        task="For each theme count the passages of this period only and judge their sentiment from -1 to 1.",
    ),
    "guidance": Spec(
        ("targets for the year", "revenue against what was guided", "margin against what was guided", "capital spending plan", "changes to guidance", "guidance withdrawn", "reasons a target was missed"),
        6, sections=("guidance", "financial_results", "prepared_remarks"), many_periods=True,
        answer="struct<guidance_items:array<struct<metric:string,period:string,guided_in:string,guidance:string,actual:string,outcome:string,miss_reason:string>>>",
        task="List each target with what became of it: beat, miss, in_line, withdrew or pending.",
    ),
    "risk": Spec(
        ("regulatory action", "input costs", "currency and rates", "customer concentration", "litigation", "cyber incidents", "supply disruption", "credit quality", "key people", "demand slowdown"),
        5, sections=("risk_factors", "qa_session", "guidance"),
        answer="struct<risks:array<struct<risk:string,severity:string,mention_count_current:int,mention_count_previous:int,evidence:string,key_quotes:array<string>>>,summary:string>",
        task="List the risks named in this period only, how often, and how grave each is.",
    ),
}


def system_prompt(signal: str) -> str:
    spec = SPECS[signal]
    return f"{spec.task} Answer with one JSON object of the form {spec.answer}. Quote the evidence word for word."


def user_prompt(company: Column, period: Column, evidence: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("Company: "), company, F.lit(", period "), period), evidence)
