"""Turtle files, written and read in parallel.

Statements are sorted by subject over a range partitioning, so equal subjects
stand together and a subject with a third of all statements still spreads over
files.  Each line is a whole statement: a subject with its predicates and their
objects, up to a number of triples, then the next line repeats the subject.
Every file begins with the prefixes, so each is a Turtle document by itself, and
a reader can split files at statements.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"

#: No more distinct prefixes than this are expected in a data set.
MOST_PREFIXES = 1000

#: A reader holds no more triples than this as Python objects, however many a batch of statements has.
READ_AT_ONCE = 10_000

_LOCAL = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_-]*)\Z")
_TOKEN = re.compile(
    r"""\s*(?:(?P<iri><[^>]*>)|(?P<text>"(?:[^"\\\n]|\\.)*")(?:\^\^(?P<kind><[^>]*>|[A-Za-z][\w-]*:[\w-]*)|(?P<lang>@[A-Za-z-]+))?|(?P<name>(?:[A-Za-z][\w-]*)?:[\w%-]*)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>a|true|false)\b|(?P<mark>[;,.]))"""
)
_PREFIX = re.compile(r"@prefix\s+([A-Za-z][\w-]*)?:\s+<([^>]*)>\s*\.?\s*\Z")
XSD = "http://www.w3.org/2001/XMLSchema#"


def _short(term: str, prefixes: list[tuple[str, str]]) -> str:
    if term.startswith("<"):
        for name, base in prefixes:
            if term.startswith(f"<{base}") and _LOCAL.match(local := term[len(base) + 1 : -1]):
                return f"{name}:{local}"
    return term


def turtle_lines(statements: DataFrame, prefixes: dict[str, str], most: int = 500) -> DataFrame:
    """(value): the lines of the files.  statements(s, p, o) holds terms as in
    N-Triples (<iri> or "text", with ^^<type> or @lang); repeated statements
    count once, those with a null part not at all."""
    known = sorted(prefixes.items(), key=lambda x: -len(x[1]))
    head = [f"@prefix {n}: <{b}> ." for n, b in sorted(prefixes.items())]

    def run(batches):
        began, subject, predicate, parts, n = False, None, None, [], 0

        def close():
            return "".join(parts) + " ."

        for b in batches:
            lines = []
            if b.num_rows and not began:
                lines += head
                began = True
            for s, p, o in zip(*(b.column(c).to_pylist() for c in ("s", "p", "o")), strict=True):
                if s != subject or n >= most:
                    if parts:
                        lines.append(close())
                    subject, predicate, parts, n = s, None, [_short(s, known)], 0
                if p == predicate:
                    parts.append(", " + _short(o, known))
                else:
                    parts.append(("; " if predicate else " ") + ("a" if p == RDF_TYPE else _short(p, known)) + " " + _short(o, known))
                    predicate = p
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.string())], names=["value"])

    d = statements.select("s", "p", "o").where("s is not null and p is not null and o is not null").distinct()
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartitionByRange(parts, "s", "p", "o").sortWithinPartitions("s", "p", "o").mapInArrow(run, "value string")


def write_turtle(statements: DataFrame, path: str, prefixes: dict[str, str], mode: str = "error", most: int = 500) -> None:
    turtle_lines(statements, prefixes, most).write.mode(mode).option("lineSep", "\n").text(path)


def _terms(statement: str, prefixes: dict[str, str]):
    """(s, p, o) of one statement, terms as in N-Triples."""

    def whole(name: str) -> str:
        head, _, local = name.partition(":")
        if head not in prefixes:
            raise ValueError(f"prefix {head}: is not declared")
        return f"<{prefixes[head]}{local}>"

    at, row, predicate = 0, [], None
    text = statement.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood as Turtle: {text[at : at + 80]!r}")
        at = m.end()
        if mark := m["mark"]:
            if mark == ";":
                row, predicate = row[:1], None
            elif mark == ".":
                row, predicate = [], None
            continue
        if m["text"] is not None:
            kind = m["kind"]
            term = m["text"] + (f"^^{kind if kind.startswith('<') else whole(kind)}" if kind else m["lang"] or "")
        elif m["number"] is not None:
            n = m["number"]
            term = f'"{n}"^^<{XSD}{"double" if "e" in n.lower() else "decimal" if "." in n else "integer"}>'
        elif m["word"] is not None:
            term = RDF_TYPE if m["word"] == "a" else f'"{m["word"]}"^^<{XSD}boolean>'
        else:
            term = m["iri"] or whole(m["name"])
        if not row:
            row = [term]
        elif predicate is None:
            predicate = term
        else:
            yield row[0], predicate, term


def _triples(prefixes: dict[str, str]):
    def run(batches):
        for b in batches:
            each = (x for v in b.column("value") for x in _terms(v.as_py(), prefixes))
            while rows := list(islice(each, READ_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["s", "p", "o"])

    return run


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of Turtle files whose statements end in " ." and a line break;
    a statement may run over several lines.  Blank nodes, collections and base
    addresses are not read: such files fail."""
    records = spark.read.option("lineSep", " .\n").text(path).where("trim(value) <> ''")
    directive = F.ltrim("value").startswith("@prefix")
    found = records.where(directive).select("value").distinct().take(MOST_PREFIXES + 1)
    if len(found) > MOST_PREFIXES:
        raise ValueError(f"over {MOST_PREFIXES} prefixes")
    prefixes: dict[str, str] = {}
    for r in found:
        m = _PREFIX.match(r["value"].strip())
        if not m or prefixes.setdefault(m[1] or "", m[2]) != m[2]:
            raise ValueError(f"not understood or two meanings: {r['value'][:80]!r}")

    return records.where(~directive).mapInArrow(_triples(prefixes), "s string, p string, o string")
