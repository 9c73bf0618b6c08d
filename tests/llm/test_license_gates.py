"""No gate of op7 leaves out a text that a rule matches."""

import random
import re

from memloom.llm import licenses


def texts_of(pattern, rng, n=60):
    """Texts that match ``pattern``, with every branch of its groups chosen at random."""
    body = pattern.removeprefix("(?<= )").removesuffix("(?= )")

    def pick(group):
        return "" if group[2] and rng.random() < 0.5 else rng.choice(group[1].split("|"))

    for _ in range(n):
        text, before = body, None
        while text != before:
            before, text = text, re.sub(r"\(\?:([^()]*)\)(\?)?", pick, text)
        text = re.sub(r"\[(\w+)\]", lambda m: rng.choice(m[1]), text).replace("\\S+", "whatever")
        yield re.sub(r"(.)\?", lambda m: rng.choice([m[1], ""]), text)


def test_gates_keep_every_branch_of_every_rule(spark):
    rng, table = random.Random(3), licenses.rules()
    made = {}
    for r in table:
        for text in texts_of(r.pattern, rng):
            assert re.search(r.pattern, f" {text} "), (r.pattern, text)
            assert r.keyword in f" {text} ", (r.keyword, text)
            made[text] = r.label
    rows = spark.createDataFrame(list(made.items()), "text string, label string")
    assert rows.where(~licenses.likely(rows["text"], table)).collect() == []


def test_forms_that_were_left_out(spark):
    rows = [(1, "Proprietary and confidential"), (2, "open rail m"), (3, "Nara Institute of Science and Technology License")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["labels"] for r in found.collect()} == {1: "proprietary", 2: "openrail", 3: "naist"}
