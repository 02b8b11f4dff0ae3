"""Sections of chunks: rules run only on texts that have one of their words, with the same answers."""

import random

from quartermark.operators import chunking


def test_sections_as_by_the_rules_alone():
    words = [w for ws in chunking.SECTION_WORDS for w in ws] + ["remarks", "questions and answer", "Operator: a", "question", "Expect a", "quarter", "full year", "long-term", "rıſK", "RISK INCLUDE", "risK factors", "İndustry", "İ", "MACRO\n", "Ünder", "a", "b"]
    pick = random.Random(7)
    for _ in range(20_000):
        text = pick.choice([" ", "", "\n"]).join(pick.choice(words) for _ in range(pick.randint(0, 5)))
        text = pick.choice([str, str.upper, str.title])(text)
        assert chunking.section_of(text) == next((n for rule, n in chunking.SECTION_RULES if rule.search(text)), "unknown"), text


def test_no_rule_runs_without_its_words(monkeypatch):
    class Counted:
        calls = 0

        def search(self, text):
            Counted.calls += 1

    monkeypatch.setattr(chunking, "SECTION_RULES", tuple((Counted(), n) for _, n in chunking.SECTION_RULES))
    monkeypatch.setattr(chunking, "LOWER_RULES", tuple((Counted(), n, w) for _, n, w in chunking.LOWER_RULES))
    assert chunking.section_of("Nothing to be told here, été.") == "unknown" and Counted.calls == 0
