"""Outcomes of tests: classification, expected and actual values, joins with the tests, rates; logs of test runners.

Log readers take a column with the whole output of one run. JSON readers are expressions; readers of text logs split
the output into lines within the row. Null and empty outputs have no results.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import or_empty, stripped
from plumbline.operators.extract import Registry, rows_from
from plumbline.operators.reports import last_per_key

RESULT = "nodeid string, outcome string, stdout string, stderr string, traceback string, duration double"
_ASSERT = r"(?m)assert (.+?) == (.+?)$"


def outcome(raw: Column) -> Column:
    """passed, failed and error as the model names them; all else, and null, is undetermined."""
    return F.when(raw == "passed", "pass").when(raw == "failed", "fail").when(raw == "error", "error").otherwise("undetermined")


def expected_actual(traceback: Column) -> tuple[Column, Column]:
    """(expected, actual) of the first failed comparison in a traceback: the right and the left side; null without one."""
    has = F.regexp_like(or_empty(traceback), F.lit(_ASSERT))
    return F.when(has, stripped(F.regexp_extract(traceback, _ASSERT, 2))), F.when(has, stripped(F.regexp_extract(traceback, _ASSERT, 1)))


def joined_results(tests: DataFrame, results: DataFrame, order: list[Column]) -> DataFrame:
    """tests (test_name, ...) left joined with results (nodeid, outcome, traceback, duration, ...) on the last part of the
    node id; of several results of a name the last by `order` counts. A test without a result is undetermined, its
    duration 0. Durations come in seconds and leave in milliseconds."""
    named = results.withColumn("test_name", F.element_at(F.split("nodeid", "::"), -1))
    one = last_per_key(named, ["test_name"], order)
    expected, actual = expected_actual(F.col("traceback"))
    rows = tests.join(one.select("test_name", F.col("outcome").alias("_o"), "traceback", "duration"), "test_name", "left")
    return rows.select(*tests.columns, outcome(F.col("_o")).alias("outcome"), expected.alias("expected"), actual.alias("actual"), "traceback", (F.coalesce("duration", F.lit(0.0)) * 1000).alias("execution_time_ms"))


# -- runners' logs -----------------------------------------------------------------------------------------------------


def go_events(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, nodeid, outcome, stdout, traceback, duration) from JSON lines: events of one test folded, lines that are no
    JSON and events without a test skipped. The events of a test are few; they are grouped by (key, test)."""
    event = "Test string, Action string, Output string, Elapsed double"
    lines = logs.select(key, F.posexplode(F.split(or_empty(F.col(log)), "\n")).alias("no", "line")).filter(F.trim("line").startswith("{"))
    events = lines.select(key, "no", F.from_json("line", event).alias("e")).filter("e.Test is not null and e.Test <> ''").select(key, "no", "e.*")
    ends = F.col("Action").isin("pass", "fail", "skip")
    folded = events.groupBy(key, F.col("Test").alias("nodeid")).agg(
        F.max_by(F.when(ends, F.col("Action")), F.when(ends, F.col("no"))).alias("action"), F.max_by(F.when(ends, F.col("Elapsed")), F.when(ends, F.col("no"))).alias("duration"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("Action") == "output", F.struct("no", "Output")))), lambda x: x["Output"]), "").alias("stdout"),
    )
    result = F.when(F.col("action") == "pass", "passed").when(F.col("action") == "fail", "failed").otherwise("error")
    return folded.select(key, "nodeid", result.alias("outcome"), "stdout", F.when(F.col("action") == "fail", F.col("stdout")).alias("traceback"), F.coalesce("duration", F.lit(0.0)).alias("duration"))


def nested_results(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, nodeid, outcome, traceback, duration in seconds) from one JSON document of files with assertions; noise before
    the first brace is skipped; a node id is the titles around it joined by ' > '."""
    shape = "testResults array<struct<assertionResults:array<struct<ancestorTitles:array<string>,title:string,status:string,duration:double,failureMessages:array<string>>>>>"
    start = F.instr(or_empty(F.col(log)), "{")
    doc = F.from_json(F.when(start > 0, F.substring(F.col(log), start, F.length(log))), shape)
    one = logs.select(key, F.posexplode(doc["testResults"]).alias("f", "file")).select(key, "f", F.posexplode("file.assertionResults").alias("t", "r")).select(key, "f", "t", "r.*")
    title = F.array_join(F.concat(F.coalesce("ancestorTitles", F.array().cast("array<string>")), F.array("title")), " > ")
    result = F.when(F.col("status") == "passed", "passed").when(F.col("status") == "failed", "failed").otherwise("error")
    message = F.array_join(F.coalesce("failureMessages", F.array().cast("array<string>")), "\n")
    return one.select(key, title.alias("nodeid"), result.alias("outcome"), F.when(message != "", message).alias("traceback"), (F.coalesce("duration", F.lit(0.0)) / 1000).alias("duration"))


def pytest_results(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, the columns of RESULT) from a JSON array of results."""
    shape = "array<struct<nodeid:string,outcome:string,stdout:string,stderr:string,traceback:string,duration:double>>"
    return logs.select(key, F.explode(F.from_json(F.col(log), shape)).alias("r")).select(key, "r.*")


_TREE = re.compile(r"[│├└─\s]+(\w+\([^)]*\))\s+(\S.*)")
_GOOD, _BAD = ("✔", "✓", "SUCCESSFUL", "PASSED"), ("✘", "✗", "FAILED", "ABORTED")


def read_junit(output: str | None) -> list[dict]:
    """Results of a console run: lines of the tree with marks or words; without any, as many as the summary counts."""
    lines = (output or "").splitlines()
    out = []
    for i, line in enumerate(lines):
        m = _TREE.search(line)
        if not m:
            continue
        good, bad = any(x in m.group(2) for x in _GOOD), any(x in m.group(2) for x in _BAD)
        if good or bad:
            out.append({"nodeid": m.group(1), "outcome": "passed" if good else "failed", "traceback": None if good else _below(lines, i), "duration": 0.0})
    if out:
        return out
    for word, name, result in (("successful", "test_", "passed"), ("failed", "test_failed_", "failed")):
        m = re.search(rf"(?i)\[\s*(\d+)\s+tests?\s+{word}\s*\]", output or "")
        out += [{"nodeid": f"{name}{k + 1}", "outcome": result, "traceback": output if result == "failed" else None, "duration": 0.0} for k in range(int(m.group(1)) if m else 0)]
    return out


def _below(lines: list[str], i: int) -> str | None:
    """The message below a failed line, up to the next test or, once begun, a blank line."""
    taken: list[str] = []
    for line in lines[i + 1 :]:
        if re.search(r"[├└]─\s+\w+\(", line) or not line.strip():
            if taken:
                break
            continue
        taken.append(line.rstrip())
    return "\n".join(taken) or None


def read_cargo(output: str | None) -> list[dict]:
    """Results of 'test x ... ok' lines; the block below '---- x stdout ----' is a failed test's traceback."""
    text = output or ""
    blocks = {m.group(1): m.group(2).strip() for m in re.finditer(r"(?ms)^---- (\S+) stdout ----\n(.*?)(?=^---- |^failures:|\Z)", text)}
    kinds = {"ok": "passed", "FAILED": "failed", "ignored": "error"}
    return [{"nodeid": m.group(1), "outcome": kinds[m.group(2)], "traceback": blocks.get(m.group(1)) if m.group(2) == "FAILED" else None, "duration": 0.0} for m in re.finditer(r"(?m)^test (\S+)(?: - should panic)? \.\.\. (ok|FAILED|ignored)", text)]


def text_reader(read: Callable[[str | None], list[dict]]) -> Callable[[DataFrame, str, str], DataFrame]:
    """A log reader (logs, key, log) from a function that reads one run's output."""
    return lambda logs, key, log: rows_from(logs, [key], [log], RESULT, lambda text: [{"stdout": "", "stderr": "", **r} for r in read(text)])


#: Readers (logs, key, log) -> rows with (key, nodeid, outcome, traceback, duration, ...) by language.
LOGS = Registry("log reader")
LOGS.register("python", pytest_results)
LOGS.register("javascript", nested_results)
LOGS.register("typescript", nested_results)
LOGS.register("go", go_events)
LOGS.register("java", text_reader(read_junit))
LOGS.register("rust", text_reader(read_cargo))


def text_results(logs: DataFrame, key: str, log: str, language: str) -> DataFrame:
    """The results in the logs of a registered language; an unknown language is an error that names the known ones."""
    return LOGS.require(language)(logs, key, log)


# -- answers of the model ----------------------------------------------------------------------------------------------


def _bracketed(code: str, language: str) -> bool:
    from plumbline.functions.codetext import syntax_error

    return syntax_error(code if language != "go" else "package p\n" + code, language) is None


FRAMEWORKS = Registry("test framework")
FRAMEWORKS.register("pytest", lambda code: _parses(code))
FRAMEWORKS.register("jest", lambda code: bool(re.search(r"\b(?:test|it|describe)\s*\(", code)) and _bracketed(code, "javascript"))
FRAMEWORKS.register("gotest", lambda code: "func Test" in code and '"testing"' in code and _bracketed(code, "go"))
FRAMEWORKS.register("junit", lambda code: "@Test" in code and "class " in code and _bracketed(code, "java"))
FRAMEWORKS.register("cargotest", lambda code: "#[test]" in code and "fn " in code and _bracketed(code, "rust"))


def _parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def test_code(answer: str | None, framework: str = "pytest") -> str | None:
    """The test in a model's answer, or None: the first fenced block or the whole answer; for pytest the imports and the
    first test function of it; only if the framework takes its syntax."""
    if not answer or not answer.strip():
        return None
    fenced = re.search(r"```(?:\w+)?[ \t]*\n(.*?)```", answer, re.S)
    code = fenced.group(1) if fenced else answer
    valid = FRAMEWORKS.require(framework)
    if framework != "pytest":
        code = code.strip()
        return code if code and valid(code) else None
    lines = code.split("\n")
    first = next((i for i, x in enumerate(lines) if x.lstrip().startswith("def test_")), None)
    if first is None:
        return None
    margin = len(lines[first]) - len(lines[first].lstrip())
    last = next((i for i in range(first + 1, len(lines)) if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= margin), len(lines))
    imports = [x for x in lines[:first] if x.strip().startswith(("import ", "from "))]
    made = "\n".join([*imports, *[""] * bool(imports), *lines[first:last]]).rstrip()
    return made if valid(made) else None


def test_name(code: str | None, framework: str = "pytest", subject: str = "", category: str = "") -> str | None:
    """The first test function of pytest code; for other frameworks a name made of subject and category."""
    if framework != "pytest":
        return f"test_{subject}_{category}"
    tree = ast.parse(code) if code and _parses(code) else None
    return next((n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name.startswith("test_")), None) if tree else None


def synthesized(answers: DataFrame, keep: list[str], answer: str, framework: str = "pytest", subject: str = "subject", category: str = "category") -> DataFrame:
    """keep columns, test_code, test_name: the answers that hold a valid test; the others are dropped."""

    def take(text: str | None, s: str | None, c: str | None) -> list[dict]:
        code = test_code(text, framework)
        name = test_name(code, framework, s or "", c or "") if code else None
        return [{"test_code": code, "test_name": name}] if name else []

    return rows_from(answers, keep, [answer, subject, category], "test_code string, test_name string", take)


def syntax_checks(tests: DataFrame, keep: list[str], code: str, framework: str) -> DataFrame:
    """keep columns, valid: whether each test's code is taken by the framework named in a column; unknown ones take nothing."""

    def look(text: str | None, name: str | None) -> list[dict]:
        check = FRAMEWORKS.get(name)
        return [{"valid": bool(check and text and check(text))}]

    return rows_from(tests, keep, [code, framework], "valid boolean", look)


#: What a module of tests begins with, by framework.
MODULE_HEADS = {"pytest": "import copy\n\nimport pytest\n", "jest": "", "junit": "", "gotest": "package source\n", "cargotest": ""}


def test_modules(tests: DataFrame, key: str, order: str, framework: str = "pytest") -> DataFrame:
    """(key, module): the tests of each key as one text to be written and run elsewhere; a key's tests are one function's."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "test_code"))), lambda t: t["test_code"])
    return tests.filter("test_code <> ''").groupBy(key).agg(F.concat(F.lit(MODULE_HEADS[framework]), F.lit("\n\n"), F.array_join(parts, "\n\n\n"), F.lit("\n")).alias("module"))
