"""The claim patterns: which phrases of a documentation state a behaviour.

Fixed values, in natural order: number, category, name, pattern. Named groups: subject, object, condition.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    number: int
    category: str
    name: str
    regex: str
    must: bool = False  # whether the match has to hold the word "must"


PATTERNS = (
    Pattern(1, "RSV", "returns_type", r"(?i)returns?\s+(?:a\s+)?(?P<object>\w[\w\[\], ]*)"),
    Pattern(2, "RSV", "returns_none", r"(?i)returns?\s+None"),
    Pattern(3, "RSV", "returns_bool", r"(?i)returns?\s+(?:True|False|a\s+bool(?:ean)?)"),
    Pattern(4, "RSV", "returns_list", r"(?i)returns?\s+(?:a\s+)?(?:sorted\s+)?list\s*(?:of\s+(?P<object>\w[\w\[\], ]*))?"),
    Pattern(5, "RSV", "returns_dict", r"(?i)returns?\s+(?:a\s+)?dict(?:ionary)?\s*(?:of\s+(?P<object>\w[\w\[\], ]*))?"),
    Pattern(6, "RSV", "returns_tuple", r"(?i)returns?\s+(?:a\s+)?tuple\s*(?:of\s+(?P<object>\w[\w\[\], ]*))?"),
    Pattern(7, "RSV", "returns_int", r"(?i)returns?\s+(?:a(?:n)?\s+)?int(?:eger)?"),
    Pattern(8, "RSV", "returns_float", r"(?i)returns?\s+(?:a\s+)?float"),
    Pattern(9, "RSV", "returns_string", r"(?i)returns?\s+(?:a\s+)?str(?:ing)?"),
    Pattern(10, "RSV", "returns_self", r"(?i)returns?\s+self"),
    Pattern(11, "PCV", "param_must_be", r"(?i)(?P<subject>\w+)\s+must\s+be\s+(?:a\s+)?(?P<object>\w[\w\[\], ]*)"),
    Pattern(12, "PCV", "param_should_be", r"(?i)(?P<subject>\w+)\s+should\s+be\s+(?:a\s+)?(?P<object>\w[\w\[\], ]*)"),
    Pattern(13, "PCV", "param_cannot_be", r"(?i)(?P<subject>\w+)\s+(?:cannot|can\s*not|can't)\s+be\s+(?P<object>\w[\w\[\], ]*)"),
    Pattern(14, "PCV", "param_expects", r"(?i)expects?\s+(?P<subject>\w+)\s+(?:to\s+be\s+)?(?:a\s+)?(?P<object>\w[\w\[\], ]*)"),
    Pattern(15, "PCV", "param_requires", r"(?i)(?P<subject>\w+)\s+(?:is\s+)?required\s+to\s+be\s+(?:a\s+)?(?P<object>\w[\w\[\], ]*)"),
    Pattern(16, "PCV", "param_must_not_be", r"(?i)(?P<subject>\w+)\s+must\s+not\s+be\s+(?P<object>\w[\w\[\], ]*)"),
    Pattern(17, "PCV", "param_accepts", r"(?i)accepts?\s+(?:only\s+)?(?P<object>\w[\w\[\], |]*)\s+(?:as\s+)?(?P<subject>\w+)?"),
    Pattern(18, "PCV", "param_type_constraint", r"(?i)(?P<subject>\w+)\s+(?:must|should)\s+be\s+(?:of\s+)?type\s+(?P<object>\w[\w\[\], ]*)"),
    Pattern(19, "PCV", "param_non_negative", r"(?i)(?P<subject>\w+)\s+(?:must|should)\s+be\s+(?:a\s+)?(?:non[- ]negative|positive)(?:\s+(?P<object>\w+))?", True),
    Pattern(20, "PCV", "param_non_empty", r"(?i)(?P<subject>\w+)\s+(?:must|should|cannot)\s+(?:not\s+)?be\s+(?:non[- ]empty|empty|None|null)", True),
    Pattern(21, "SEV", "does_not_modify", r"(?i)does\s+not\s+modify\s+(?:the\s+)?(?P<subject>\w+)"),
    Pattern(22, "SEV", "modifies_in_place", r"(?i)modif(?:ies|y)\s+(?:the\s+)?(?P<subject>\w+)\s+in[- ]place"),
    Pattern(23, "SEV", "returns_new", r"(?i)returns?\s+(?:a\s+)?new\s+(?P<object>\w+)"),
    Pattern(24, "SEV", "mutates", r"(?i)mutates?\s+(?:the\s+)?(?P<subject>\w+)"),
    Pattern(25, "SEV", "sorts_in_place", r"(?i)sorts?\s+(?:the\s+)?(?P<subject>\w+)\s+in[- ]place"),
    Pattern(26, "SEV", "no_side_effects", r"(?i)(?:has\s+)?no\s+side[- ]effects?"),
    Pattern(27, "SEV", "pure_function", r"(?i)(?:is\s+a\s+)?pure\s+function"),
    Pattern(28, "SEV", "updates_in_place", r"(?i)updates?\s+(?:the\s+)?(?P<subject>\w+)\s+in[- ]place"),
    Pattern(29, "ECV", "raises_exception", r"(?i)raises?\s+(?P<object>\w+Error|\w+Exception)\s*(?:if\s+(?P<condition>.+))?"),
    Pattern(30, "ECV", "throws_exception", r"(?i)throws?\s+(?:a\s+)?(?P<object>\w+Error|\w+Exception)\s*(?:if\s+(?P<condition>.+))?"),
    Pattern(31, "ECV", "raises_on_invalid", r"(?i)raises?\s+(?P<object>\w+Error|\w+Exception)\s+(?:on|for|when)\s+(?:invalid|bad|wrong)\s+(?P<condition>\w+)"),
    Pattern(32, "ECV", "raises_if_none", r"(?i)raises?\s+(?P<object>\w+Error|\w+Exception)\s+if\s+(?P<subject>\w+)\s+is\s+None"),
    Pattern(33, "ECV", "raises_type_error", r"(?i)raises?\s+TypeError\s*(?:if\s+(?P<condition>.+))?"),
    Pattern(34, "ECV", "raises_value_error", r"(?i)raises?\s+ValueError\s*(?:if\s+(?P<condition>.+))?"),
    Pattern(35, "ECV", "raises_key_error", r"(?i)raises?\s+KeyError\s*(?:if\s+(?P<condition>.+))?"),
    Pattern(36, "ECV", "raises_index_error", r"(?i)raises?\s+IndexError\s*(?:if\s+(?P<condition>.+))?"),
    Pattern(37, "COV", "handles_case", r"(?i)handles?\s+(?:the\s+)?(?:case\s+(?:where|when|of)\s+)?(?P<object>.+?)(?:\.|$)"),
    Pattern(38, "COV", "supports", r"(?i)supports?\s+(?P<object>\w[\w\s,]*?)(?:\.|$)"),
    Pattern(39, "COV", "works_with", r"(?i)works?\s+with\s+(?P<object>\w[\w\s,]*?)(?:\.|$)"),
    Pattern(40, "COV", "processes", r"(?i)processes?\s+(?P<object>\w[\w\s,]*?)(?:\.|$)"),
    Pattern(41, "COV", "accepts_input", r"(?i)accepts?\s+(?P<object>\w[\w\s,|]*?)\s+(?:as\s+)?input"),
    Pattern(42, "COV", "implements", r"(?i)implements?\s+(?P<object>\w[\w\s,]*?)(?:\.|$)"),
    Pattern(43, "CCV", "time_complexity", r"(?i)(?:time\s+)?complexity\s*(?:is\s+)?O\((?P<object>[^)]+)\)"),
    Pattern(44, "CCV", "space_complexity", r"(?i)space\s+complexity\s*(?:is\s+)?O\((?P<object>[^)]+)\)"),
    Pattern(45, "CCV", "runs_in", r"(?i)runs?\s+in\s+O\((?P<object>[^)]+)\)(?:\s+time)?"),
    Pattern(46, "CCV", "linear_time", r"(?i)(?:runs?\s+in\s+)?linear\s+time"),
    Pattern(47, "CCV", "constant_time", r"(?i)(?:runs?\s+in\s+)?constant\s+time"),
)


#: A word, or one of several, without which a pattern cannot match; in lower case, by pattern number.
TRIGGERS = {
    **dict.fromkeys(range(1, 11), ("return",)), 11: ("must",), 12: ("should",), 13: ("can",), 14: ("expect",), 15: ("required",), 16: ("must",), 17: ("accept",), 18: ("must", "should"), 19: ("must", "should"), 20: ("must", "should", "cannot"),
    21: ("modify",), 22: ("modif",), 23: ("return",), 24: ("mutate",), 25: ("sort",), 26: ("side",), 27: ("pure",), 28: ("update",), **dict.fromkeys((29, 31, 32, 33, 34, 35, 36), ("raise",)), 30: ("throw",),
    37: ("handle",), 38: ("support",), 39: ("work",), 40: ("processe",), 41: ("accept",), 42: ("implement",), 43: ("complexity",), 44: ("complexity",), 45: ("run",), 46: ("linear",), 47: ("constant",),
}


def java(regex: str, unicode: bool = True) -> str:
    """The pattern for the JVM: its group syntax, UNIX lines, and letters of any script unless `unicode` is False."""
    return ("(?Ud)" if unicode else "(?d)") + regex.replace("(?P<", "(?<")


def group_number(regex: str, name: str) -> int:
    """The number of a named group; 0 (the whole match) if the pattern has none of that name."""
    number, i = 0, 0
    while i < len(regex):
        if regex[i] == "\\":
            i += 2
            continue
        if regex[i] == "[":
            i = regex.index("]", i + 2 if regex[i + 1 : i + 2] == "]" else i + 1)
            while regex[i - 1] == "\\":
                i = regex.index("]", i + 1)
        elif regex[i] == "(" and (regex[i + 1] != "?" or regex.startswith("(?P<", i)):
            number += 1
            if regex.startswith(f"(?P<{name}>", i):
                return number
        i += 1
    return 0
