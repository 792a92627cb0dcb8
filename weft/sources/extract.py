"""Facts from notes: a pluggable extractor answers in JSON, which is validated and turned into rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .ontology import RELATIONS, is_relation
from .schemas import RESPONSE

#: (note id, content) -> facts as dicts of subject, relation, object, confidence, source_quote.
Extractor = Callable[[str, str], Iterable[dict]]

_RULES = [(r, re.compile(rf"^(.+?) {r.replace('_', ' ')} (.+)$")) for r in RELATIONS]


def rule_extractor(note_id: str, content: str) -> list[dict]:
    """Sentences of the form `<subject> <relation in words> <object>`."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", content or ""):
        text = sentence.rstrip(".!?")
        for relation, rule in _RULES:
            m = rule.match(text)
            if m:
                out.append({"subject": m[1], "relation": relation, "object": m[2], "confidence": 0.8, "source_quote": sentence})
                break
    return out


def respond(notes: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """note_id, response (JSON, null where the extractor failed), error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for note, content in zip(pdf["note_id"], pdf["content"], strict=True):
                try:
                    rows.append((note, json.dumps({"triples": list(extractor(note, content))}), None))
                except Exception as e:  # one note's failure is its own result
                    rows.append((note, None, str(e)))
            yield pd.DataFrame(rows, columns=["note_id", "response", "error"])

    return notes.select("note_id", "content").mapInPandas(run, "note_id string, response string, error string")


def parse(responses: DataFrame) -> DataFrame:
    """note_id, ok, error, triples: one wrong entry fails the whole note."""
    t = F.from_json("response", RESPONSE)["triples"]
    good = F.forall(
        t,
        lambda x: x["subject"].isNotNull()
        & x["object"].isNotNull()
        & F.coalesce(is_relation(x["relation"]), F.lit(False))
        & F.coalesce(x["confidence"].between(0.0, 1.0), F.lit(False))
        & x["source_quote"].isNotNull(),
    )
    ok = F.coalesce(good, F.lit(False))
    error = F.when(~ok, F.coalesce("error", F.lit("invalid response")))
    return responses.select("note_id", ok.alias("ok"), error.alias("error"), F.when(ok, t).alias("triples"))


def to_triples(parsed: DataFrame) -> DataFrame:
    """Rows of the notes that are ok. Ids count the facts whose relation is known, before blank ones are left out."""
    known = F.filter("triples", lambda x: is_relation(x["relation"]))
    rows = parsed.where("ok").select("note_id", F.posexplode(known).alias("i", "t"))
    rows = rows.select(
        F.concat("note_id", F.lit("-x"), "i").alias("triple_id"),
        trimmed(F.col("t.subject")).alias("subject_text"),
        F.col("t.relation").alias("relation"),
        trimmed(F.col("t.object")).alias("object_text"),
        F.col("t.confidence").alias("confidence"),
        F.col("t.source_quote").alias("source_quote"),
        F.col("note_id").alias("source_note_id"),
    )
    return rows.where((F.length("subject_text") > 0) & (F.length("object_text") > 0))


def extract(notes: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    return to_triples(parse(respond(notes, extractor)))
