"""Strict JSON answers of models, and what is wrong with them.

Spark's VARIANT accepts text after a complete value and rejects repeated keys,
so answers are parsed in an Arrow UDF: the whole text strictly, else what lies
between the outermost braces. What a note must hold is a table (`NOTE`) that one
walk checks; it lists all errors, in the table's order.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import sanitize_response

TEXT, INTEGER, SCALAR = "a non-empty string", "an integer", "a scalar or null"


class Maybe(list):
    """A list that may be absent or null."""


#: Fields of a note: a kind, a list of such, or an object.
NOTE = {
    "title": TEXT,
    "summary": TEXT,
    "key_concepts": [{"concept": TEXT, "simple_explanation": TEXT, "why_it_matters": TEXT}],
    "important_features_or_tools": [
        {
            "name": TEXT, "type": TEXT, "what_it_does": TEXT, "when_to_use_it": TEXT,
            "important_parameters": Maybe([{"parameter": TEXT, "meaning": TEXT, "example_value": SCALAR}]),
        }
    ],
    "practical_workflow": [{"step": INTEGER, "action": TEXT, "reason": TEXT}],
    "common_mistakes_or_confusions": [{"mistake": TEXT, "correction": TEXT}],
    "project_usage_notes": [TEXT],
}

KINDS = {
    TEXT: lambda v: isinstance(v, str) and bool(v.strip()),
    INTEGER: lambda v: isinstance(v, int),
    SCALAR: lambda v: v is None or isinstance(v, (str, int, float, bool)),
}


def problems(value, spec, path: str = "") -> list[str]:
    """Errors of `value` against `spec`, each as `path must be ...`."""
    if isinstance(spec, str):
        return [] if KINDS[spec](value) else [f"{path} must be {spec}"]
    if isinstance(spec, list):
        if value is None and isinstance(spec, Maybe):
            return []
        if not isinstance(value, list):
            return [f"{path} must be a list"]
        return [e for i, item in enumerate(value) for e in problems(item, spec[0], f"{path}[{i}]")]
    if not isinstance(value, dict):
        return [f"{path} must be an object"]
    return [e for key, own in spec.items() for e in problems(value.get(key), own, f"{path}.{key}" if path else key)]


def note_problems(note: dict) -> list[str]:
    unknown = sorted(set(note) - set(NOTE))
    return problems(note, NOTE) + ([f"unknown keys: {', '.join(unknown)}"] if unknown else [])


def parse_object(text: str | None) -> tuple[dict | None, str | None]:
    """The JSON object in an answer, or why there is none."""
    text = text or ""
    spans = [text]
    if 0 <= text.find("{") < text.rfind("}"):
        spans.append(text[text.find("{") : text.rfind("}") + 1])
    for span in spans:
        try:
            found = json.loads(span)
        except ValueError:
            continue
        return (found, None) if isinstance(found, dict) else (None, "the answer is no JSON object")
    return None, "the answer holds no JSON object" if len(spans) == 1 else "the answer holds invalid JSON"


def checked(answer: Column) -> Column:
    """Struct json (canonical text of the object, or null), error (why there is none) and errors of a raw answer, parsed once; a valid note has no errors."""

    @F.pandas_udf("json string, error string, errors array<string>")
    def run(batch: pd.Series) -> pd.DataFrame:
        found = [parse_object(t) for t in batch]
        json_ = [None if o is None else json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for o, _ in found]
        return pd.DataFrame({"json": json_, "error": [e for _, e in found], "errors": [[e] if o is None else note_problems(o) for o, e in found]})

    return run(sanitize_response(F.coalesce(answer, F.lit(""))))


RUBRIC = ("groundedness", "completeness", "schema_quality")


def verdict(scores: Column, rubric: tuple[str, ...] = RUBRIC, low: int = 1, high: int = 5) -> Column:
    """Struct of a judge's integer scores and error, of a VARIANT or JSON object; all null but error if one is out of range."""
    kinds = {k: F.schema_of_variant(F.try_variant_get(scores, f"$.{k}", "variant")) for k in rubric}
    values = {k: F.when(kinds[k].isin("BIGINT", "BOOLEAN"), F.coalesce(F.try_variant_get(scores, f"$.{k}", "int"), F.try_variant_get(scores, f"$.{k}", "boolean").cast("int"))) for k in rubric}
    good = F.lit(True)
    for value in values.values():
        good = good & F.coalesce(value.between(low, high), F.lit(False))
    return F.struct(*[F.when(good, v).alias(k) for k, v in values.items()], F.when(~good, F.lit("a score is missing or out of range")).alias("error"))
