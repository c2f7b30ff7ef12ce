"""Graphs from files: Turtle, read statement by statement, and JSON-LD, object by object.

Rows are s, p, o, o_kind (iri, node, plain, lang, typed), o_type, with whole names. A nameless node's label is that of the
file (`_:l` before it) or a number (`_:n`), and belongs to its file. What cannot be read is a row of kind
`error` that says why, and reading goes on with the next statement or object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators.fold import fold

TRIPLE = "s string, p string, o string, o_kind string, o_type string"
# Names that the syntaxes stand for.
XSD, RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<long>\"{3}|'{3})
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:\w(?:[\w.\-]*[\w\-])?)
    |(?P<number>[+-]?(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\w\s])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[^\w\s])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[^\w\s]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES[m[3]], text) if "\\" in text else text


class _Statement:
    """The triples of one statement's tokens."""

    def __init__(self, reader: Turtle, tokens: list[tuple[str, str]]):
        self.reader, self.tokens, self.at, self.out = reader, tokens, 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *marks: str) -> tuple[str, str]:
        kind, text = self.peek()
        if marks and text not in marks:
            raise ValueError(f"{text or 'the end'} where {' or '.join(marks)} should be")
        self.at += 1
        return kind, text

    def iri(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            name = unescaped(text[1:-1])
            return urljoin(self.reader.base, name) if self.reader.base and ":" not in name.split("/")[0] else name
        if kind == "name":
            prefix, _, local = text.partition(":")
            return self.reader.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"{text or 'the end'} where a name should be")

    def add(self, s: str, p: str, o: tuple) -> None:
        self.out.append((s, p, *o))

    def node(self) -> tuple[str, str] | None:
        """A named or nameless node, and its kind; none if what comes is neither."""
        kind, text = self.peek()
        if kind in ("iri", "name"):
            return self.iri(), "iri"
        if kind == "blank":
            self.take()
            return f"_:l{text[2:]}", "node"
        if text == "[" and kind == "mark":
            self.take()
            own = self.reader.fresh()
            if self.peek() != ("mark", "]"):
                self.predicates(own)
            self.take("]")
            return own, "node"
        if text == "(" and kind == "mark":
            return self.collection()
        return None

    def collection(self) -> tuple[str, str]:
        self.take("(")
        items = []
        while self.peek() != ("mark", ")"):
            items.append(self.object())
        self.take(")")
        rest = (f"{RDF}nil", "iri")
        for item in reversed(items):
            own = self.reader.fresh()
            self.add(own, f"{RDF}first", item)
            self.add(own, f"{RDF}rest", (*rest, None))
            rest = (own, "node")
        return rest

    def object(self) -> tuple[str, str, str | None]:
        if found := self.node():
            return (*found, None)
        kind, text = self.take()
        if kind == "string":
            if self.peek()[0] == "lang":
                return text, "lang", self.take()[1][1:]
            if self.peek()[0] == "type":
                self.take()
                return text, "typed", self.iri()
            return text, "plain", None
        if kind == "number":
            return text, "typed", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if text in ("true", "false"):
            return text, "typed", f"{XSD}boolean"
        raise ValueError(f"{text or 'the end'} where an object should be")

    def predicates(self, subject: str) -> None:
        while True:
            predicate = f"{RDF}type" if self.peek() == ("word", "a") else None
            if predicate:
                self.take()
            else:
                predicate = self.iri()
            self.add(subject, predicate, self.object())
            while self.peek() == ("mark", ","):
                self.take()
                self.add(subject, predicate, self.object())
            more = False
            while self.peek() == ("mark", ";"):
                self.take()
                more = True
            if not more or self.peek()[1] in ("]", "") and self.peek()[0] in ("mark", "end"):
                return

    def read(self) -> list[tuple]:
        kind, text = self.peek()
        word = text.lower().lstrip("@")
        if (kind == "lang" or kind == "word") and word in ("prefix", "base"):
            self.take()
            if word == "base":
                self.reader.base = self.iri()
            else:
                name = self.take()[1]
                if not name.endswith(":"):
                    raise ValueError(f"{name} where a prefix should be")
                self.reader.prefixes[name[:-1]] = self.iri()
        else:
            inner = text == "["
            subject = self.node()
            if subject is None:
                raise ValueError(f"{text or 'the end'} where a subject should be")
            if not (inner and self.peek()[0] == "end"):
                self.predicates(subject[0])
        if self.at < len(self.tokens):
            raise ValueError(f"{self.peek()[1]} where the end should be")
        return self.out


class Turtle:
    """Takes a file line by line and gives the triples of each statement as it ends; it keeps a statement's tokens and the prefixes."""

    def __init__(self, prefixes: dict[str, str] | None = None):
        self.prefixes, self.base, self.tokens, self.n = dict(prefixes or {}), "", [], 0
        self.quote, self.parts = None, []  # of a string over several lines

    def fresh(self) -> str:
        self.n += 1
        return f"_:n{self.n}"

    def feed(self, line: str) -> list[tuple]:
        """line: with its line end, if it has one."""
        out, at = [], 0
        while at < len(line):
            if self.quote:
                end = re.compile(rf"(?:[^\\{self.quote[0]}]|\\.|{self.quote[0]}(?!{self.quote[0] * 2}))*", re.DOTALL).match(line, at).end()
                if not line.startswith(self.quote, end):
                    self.parts.append(line[at:])
                    break
                while line.startswith(self.quote[0], end + 3):  # quotes right before the end belong to the text
                    end += 1
                self.tokens.append(("string", unescaped("".join(self.parts) + line[at:end])))
                self.quote, at = None, end + 3
                continue
            m = _TOKEN.match(line, at)
            if m is None:
                out.append(self.failed(f"{line[at:].strip()[:40]} is no Turtle"))
                break
            kind, text, at = m.lastgroup, m[0], m.end()
            if kind == "long":
                self.quote, self.parts = text, []
            elif kind == "string":
                self.tokens.append((kind, unescaped(text[1:-1])))
            elif kind == "mark" and text == "." or kind == "iri" and self.bare():
                if kind == "iri":
                    self.tokens.append((kind, text))
                out += self.ended()
            elif kind != "space":
                self.tokens.append((kind, text))
        return out

    def bare(self) -> bool:
        """Whether the statement is a PREFIX or BASE without a full stop, and its name comes now."""
        first = self.tokens[0] if self.tokens else ("", "")
        return first[0] == "word" and (first[1].lower() == "base" and len(self.tokens) == 1 or first[1].lower() == "prefix" and len(self.tokens) == 2)

    def ended(self) -> list[tuple]:
        tokens, self.tokens = self.tokens, []
        try:
            return _Statement(self, tokens).read()
        except KeyError as error:
            return [self.failed(f"unknown prefix or escape {error}")]
        except (ValueError, RecursionError) as error:
            return [self.failed(str(error))]

    def failed(self, why: str) -> tuple:
        self.tokens = []
        return (None, None, why, "error", None)

    def close(self) -> list[tuple]:
        return [self.failed("the file ends within a statement")] if self.tokens or self.quote else []


def read_turtle(lines: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """file and triples of Turtle files. lines: file, number, text (without line end); a file is read by one task, a line at a time."""

    def step(reader: Turtle, number: int, text: str) -> tuple[Turtle, list[tuple]]:
        return reader, reader.feed(text + "\n")

    return fold(lines, ["file"], ["number"], ["number", "text"], TRIPLE, step, begin=lambda *_: Turtle(prefixes), end=lambda reader: reader.close())


class _Blocks:
    def __init__(self, prefixes: dict[str, str]):
        self.prefixes = prefixes

    def __call__(self, batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                reader = Turtle(self.prefixes)
                out += reader.feed(text or "") + reader.close()
            if out:
                yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["s", "p", "o", "o_kind", "o_type"])


def read_blocks(blocks: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Triples of blocks (one text column) of whole statements that share prefixes, read anywhere; their nameless nodes must have labels."""
    return blocks.mapInArrow(_Blocks(prefixes), TRIPLE)


class JsonLd:
    """Triples of one object. A context may hold prefixes, terms, @vocab, @base and @language; one that lies elsewhere is an error."""

    def __init__(self, label: str = ""):
        self.label, self.n, self.out = label, 0, []

    def fresh(self) -> str:
        self.n += 1
        return f"_:n{self.label}{self.n}"

    def context(self, given, above: dict) -> dict:
        found = dict(above)
        for one in given if isinstance(given, list) else [given]:
            if one is None:
                found = {}
            elif isinstance(one, str):
                raise ValueError(f"the context {one} lies elsewhere")
            else:
                found |= one
        return found

    def name(self, text: str, ctx: dict, vocab: bool = True) -> str:
        if text.startswith("_:"):
            return f"_:l{text[2:]}"
        term = ctx.get(text) if vocab else None
        if isinstance(term, dict):
            term = term.get("@id", text)
        if term is not None and term != text:
            return self.name(term, ctx)
        prefix, colon, local = text.partition(":")
        if colon and not local.startswith("//") and isinstance(ctx.get(prefix), str):
            return ctx[prefix] + local
        if colon:
            return text
        return (ctx.get("@vocab", "") if vocab else ctx.get("@base", "")) + text

    def node(self, value: dict, above: dict) -> str:
        ctx = self.context(value["@context"], above) if "@context" in value else above
        own = self.name(value["@id"], ctx, False) if "@id" in value else self.fresh()
        for key, values in value.items():
            values = values if isinstance(values, list) else [values]
            if key == "@type":
                for v in values:
                    self.out.append((own, f"{RDF}type", *self.object({"@id": v}, ctx, {}, True)))
            elif key == "@graph":
                for v in values:
                    self.node(v, ctx)
            elif not key.startswith("@"):
                predicate, term = self.name(key, ctx), ctx.get(key)
                if ":" in predicate:  # a key without a name says nothing
                    for v in values:
                        if v is not None:
                            self.out.append((own, predicate, *self.object(v, ctx, term if isinstance(term, dict) else {})))
        return own

    def object(self, v, ctx: dict, term: dict, vocab: bool = False) -> tuple[str, str, str | None]:
        if isinstance(v, dict) and "@list" in v:
            rest: tuple[str, str, str | None] = (f"{RDF}nil", "iri", None)
            items = [self.object(x, ctx, {}) for x in (v["@list"] if isinstance(v["@list"], list) else [v["@list"]])]
            for item in reversed(items):
                own = self.fresh()
                self.out += [(own, f"{RDF}first", *item), (own, f"{RDF}rest", *rest)]
                rest = (own, "node", None)
            return rest
        if isinstance(v, dict) and "@value" in v:
            value = v["@value"]
            if "@language" in v:
                return value, "lang", v["@language"]
            if "@type" in v:
                return value if isinstance(value, str) else json.dumps(value), "typed", self.name(v["@type"], ctx)
            return self.object(value, {k: x for k, x in ctx.items() if k != "@language"}, {})
        if isinstance(v, dict):
            name = self.name(v["@id"], ctx, vocab) if set(v) == {"@id"} else self.node(v, ctx)
            return name, "node" if name.startswith("_:") else "iri", None
        if isinstance(v, bool):
            return str(v).lower(), "typed", f"{XSD}boolean"
        if isinstance(v, (int, float)):
            return json.dumps(v), "typed", XSD + ("integer" if isinstance(v, int) else "double")
        if not isinstance(v, str):
            raise ValueError("a list within a list")
        kind = term.get("@type")
        if kind in ("@id", "@vocab"):
            return self.object({"@id": v}, ctx, {}, kind == "@vocab")
        if kind:
            return v, "typed", self.name(kind, ctx)
        language = term.get("@language", ctx.get("@language"))
        return (v, "lang", language) if language else (v, "plain", None)

    def read(self, text: str) -> Iterator[tuple]:
        try:
            whole = json.loads(text)
            for one in whole if isinstance(whole, list) else [whole]:
                self.node(one, {})
            return iter(self.out)
        except (ValueError, TypeError, AttributeError, KeyError, RecursionError) as error:
            return iter([(None, None, str(error), "error", None)])


def _objects(batches):
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            n += 1
            out += JsonLd(f"{part}x{n}x").read(text or "{}")
        if out:
            yield _batch(out)


def read_json_ld(objects: DataFrame) -> DataFrame:
    """Triples of JSON-LD objects (one text column), each read by itself; a nameless node without a label is a node of its own."""
    return objects.mapInArrow(_objects, TRIPLE)


def whole_names(triples: DataFrame) -> DataFrame:
    """Triples with compact names as the readers give them."""
    from groundspark.operators.triples import expanded

    bare = lambda c: F.when(F.startswith(c, F.lit("_:")), F.concat(F.lit("_:l"), F.substring(expanded(c), 3, 1 << 30))).otherwise(F.regexp_replace(expanded(c), "^<|>$", ""))
    o = F.when(F.col("o_kind").isin("iri", "node"), bare(F.col("o"))).otherwise(F.col("o"))
    return triples.select(bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), o.alias("o"), "o_kind", F.when(F.col("o_kind") == "typed", bare(F.col("o_type"))).otherwise(F.col("o_type")).alias("o_type"))
