"""Prompts for test synthesis, and what the answers hold. The model call itself is a function that the caller gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators.extract import Registry

#: What a test must show, by category; a parameter of the operators, here with a wording of our own.
GUIDANCE = {
    "RSV": "Check that the returned value or type is the one claimed.",
    "PCV": "Check that the parameter constraint holds for valid inputs and at its bounds.",
    "SEV": "Copy all arguments deeply before the call and compare those claimed unchanged afterwards.",
    "ECV": "Check that the claimed exception is raised under the claimed condition.",
    "COV": "Check that the described case is handled at all.",
    "CCV": "Measure the running time for growing inputs against the claimed bound.",
}
FRAMEWORKS = {"python": "pytest", "javascript": "jest", "typescript": "jest", "java": "junit", "go": "gotest", "rust": "cargotest"}
SYSTEM = "Write exactly one test for the claim below, from the claim and the signature only. Answer with code alone."
TEMPERATURE = 0.1
_SCHEMA = '{"type":"object","properties":{"test_code":{"type":"string"},"test_name":{"type":"string"}},"required":["test_code","test_name"]}'


#: Model calls by name, registered by the user of the library: call(system, user, temperature) -> answer.
PROVIDERS = Registry("provider")


def guidance(category: Column, texts: dict[str, str] = GUIDANCE) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), category)


def build(claims: DataFrame, signature: Column, framework: Column | None = None, texts: dict[str, str] = GUIDANCE) -> DataFrame:
    """claims plus (system, user, temperature). The user part is JSON of claim, condition, signature and subjects, and,
    but for side effects without a framework, the schema of the answer. The body of the function is never part of it."""
    parts = [F.col("predicate_object").alias("claim"), F.col("conditionality").alias("condition"), signature.alias("signature"), F.array("subject").alias("subjects")]
    plain = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    full = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(f',"output_schema":{_SCHEMA}}}'))
    system = F.concat(F.lit(SYSTEM + " "), guidance(F.col("category"), texts))
    if framework is None:
        return claims.withColumns({"system": system, "user": F.when(F.col("category") == "SEV", plain).otherwise(full), "temperature": F.lit(TEMPERATURE)})
    return claims.withColumns({"system": F.concat(F.lit("Framework: "), framework, F.lit(". "), system), "user": full, "temperature": F.lit(TEMPERATURE)})


def framework_of(language: Column) -> Column:
    """The test framework of a language; null for an unknown one (see registry.require for an error instead)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in FRAMEWORKS.items() for x in kv]), language)


def token_counts(df: DataFrame, prompt: str, response: str) -> DataFrame:
    return df.withColumns({"prompt_tokens": C.word_count(F.col(prompt)), "response_tokens": C.word_count(F.col(response))})


def code_block(text: Column) -> Column:
    """The first fenced block of an answer (plain or marked python), or the answer itself if it has none."""
    pattern = r"(?s)```(?:python)?\s*\n(.*?)```"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(text)


def retried(call: Callable[[], object], tries: int, wait: float, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """What `call` returns, tried up to `tries` times with pauses of wait, wait * factor, ... seconds between; the last
    error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k + 1 >= tries:
                raise
            sleep(wait * factor**k)
    raise ValueError("at least one try")


def answers(prompts: DataFrame, call: Callable[[str, str, float], str], retries: int = 5, wait: float = 10.0, pause: float = 0.0) -> DataFrame:
    """prompts plus (answer): `call(system, user, temperature)` for each row in batches on the executors, tried up to
    `retries` times with pauses that start at `wait` seconds and double; null where all tries failed. `pause` seconds pass
    before each row's first call. `call` must be importable on the executors. A provider is a
    function; see PROVIDERS for registering several by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str | None] = []
            for s, u, t in zip(*[b.column(c).to_pylist() for c in ("system", "user", "temperature")]):
                if pause:
                    time.sleep(pause)
                try:
                    out.append(retried(lambda: call(s, u, t), retries, wait))  # noqa: B023
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "answer"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInArrow(run, kinds + ", answer string")
