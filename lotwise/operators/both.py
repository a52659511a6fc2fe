"""One text for Spark SQL and for its SQL check.

Rules that both dialects say alike are written once. ``$part$`` names a table. LIKES(x, 'pattern') asks for a match,
FOUND(x, 'pattern', n) gives group n or null, SUBST(x, 'pattern', 'text') replaces every
match, JOINED(x, k) the group's texts by k with spaces between, unix_(x) is the time in seconds, JSONV(x, '$.path') a value as text.
"""

from __future__ import annotations

import re

from .common import table

def _calls(text: str, name: str, make) -> str:
    """Replace calls of ``name``, the last one first, so that inner ones come before those around them."""
    while (start := text.rfind(name + "(")) >= 0:
        depth, quoted, end = 0, False, start + len(name)
        for end in range(end, len(text)):
            c = text[end]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            if depth == 0:
                break
        text = text[:start] + make(*_split(text[start + len(name) + 1 : end])) + text[end + 1 :]
    return text


def _split(args: str) -> list[str]:
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(args):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            depth -= 1
        elif not quoted and c == "," and depth == 0:
            out.append(args[last:i].strip())
            last = i + 1
    return [*out, args[last:].strip()]


def spark_text(text: str) -> str:
    text = _calls(text, "LIKES", lambda x, p: f"(regexp_count({x}, r{p}) > 0)")
    text = _calls(text, "FOUND", lambda x, p, n="0": f"nullif(regexp_extract({x}, r{p}, {n}), '')")
    text = _calls(text, "SUBST", lambda x, p, by: f"regexp_replace({x}, r{p}, {by})").replace("unix_(", "unix_timestamp(").replace("JSONV(", "get_json_object(")
    text = _calls(text, "JOINED", lambda x, k: f"listagg({x}, ' ') WITHIN GROUP (ORDER BY {k})")
    return re.sub(r"\$(\w+)\$", r"{\1}", text.replace("{", "{{").replace("}", "}}"))


def check_text(text: str) -> str:
    text = _calls(text, "LIKES", lambda x, p: f"regexp_matches({x}, {p})")
    text = _calls(text, "FOUND", lambda x, p, n="0": f"nullif(regexp_extract({x}, {p}, {n}), '')")
    text = _calls(text, "SUBST", lambda x, p, by: f"regexp_replace({x}, {p}, {by}, 'g')").replace("unix_(", "epoch(").replace("JSONV(", "json_extract_string(")
    text = _calls(text, "JOINED", lambda x, k: f"string_agg({x}, ' ' ORDER BY {k})")
    return re.sub(r"\$(\w+)\$", r"\1", text)


def register(queries: dict, oracles: dict, name: str, doc: str, text: str, told: str | None = None) -> None:
    """``told`` is Spark's own text, for rules whose check leaves ties open: one of the check's results, always the same."""
    tables = sorted(set(re.findall(r"\$(\w+)\$", text)))

    def query(spark, sf_dir):
        return spark.sql(spark_text(told or text), **{t: table(spark, sf_dir, t) for t in tables})

    query.__name__, query.__doc__ = name, doc
    queries[name], oracles[name] = query, check_text(text)


def forms(key: str, *texts: str) -> str:
    """A text for each row, by turns; ``#`` in a text stands for the key."""
    def one(t: str) -> str:
        if "#" not in t:
            return f"'{t}'"
        parts = t.split("#")
        bits = [f"'{parts[0]}'"]
        for p in parts[1:]:
            bits += [f"CAST({key} AS STRING)", f"'{p}'"]
        return f"concat({', '.join(bits)})"

    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(texts)) + " END"
