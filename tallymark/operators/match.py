"""Search expressions: phrases, prefixes, AND, OR, NOT, NEAR and columns, and which rows of positions satisfy them.

    income tax            both words, anywhere         "income tax"          the words in a row
    tax*                  words that begin so           ^tax                  at the start of a column
    a OR b AND NOT c      NOT binds closest, then AND   NEAR(a "b c", 5)      at most 5 words between (10 if not said)
    title : tax           in a column                  {title county} : tax   in some of them;  - before it: in others

Words are compared folded: lower case, without diacritics. What is no such expression raises Malformed."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.values import rounded

K1, B = 1.2, 0.75
#: Characters with one base letter each, from the scripts that have them.
SCRIPTS = [(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)]


def base_letters() -> dict[str, str]:
    out = {}
    for low, high in SCRIPTS:
        for c in map(chr, range(low, high)):
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
                out[c] = parts[0]
    return out


BASE = base_letters()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    bare = F.regexp_replace(F.translate(F.lower(text), "".join(BASE), "".join(BASE.values())), r"\p{Mn}", "")
    return F.lower(bare)


def fold(text: str) -> str:
    return "".join(x for c in text.lower() for x in BASE.get(c, c) if unicodedata.category(x) != "Mn").lower()


def words(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


class Malformed(ValueError):
    pass


@dataclass
class Phrase:
    """Words in a row; the last may be a prefix. first: at the start of its column. columns: None for all."""

    terms: list[str]
    prefix: bool = False
    first: bool = False
    columns: frozenset[str] | None = None


@dataclass
class Node:
    """and, or, not: parts are nodes. phrase: the number of a phrase. near: numbers of phrases, `within` words between them."""

    kind: str
    parts: list = field(default_factory=list)
    within: int = 10


TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:,*+^-])|([^\s"(){}:,*+^-]+))')


class Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns = {c.lower(): c for c in columns}
        self.phrases: list[Phrase] = []
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise Malformed(text[at:])
            self.tokens.append(("quoted", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("sign", m[2]) if m[2] else ("word", m[3]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str:
        kind, text = self.peek()
        if wanted and text not in wanted or kind == "end":
            raise Malformed(f"{text!r} at {self.at}")
        self.at += 1
        return text

    def is_(self, kind: str, text: str) -> bool:
        return self.peek() == (kind, text)

    def whole(self) -> Node:
        out = self.either(None)
        if self.peek()[0] != "end":
            raise Malformed(self.peek()[1])
        return out

    def chain(self, word: str, part, kind: str) -> Node:
        parts = [part()]
        while self.is_("word", word):
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(kind, parts)

    def either(self, where: frozenset[str] | None) -> Node:
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", lambda: self.several(where), "not"), "and"), "or")

    def several(self, where: frozenset[str] | None) -> Node:
        """Parts side by side: all of them."""
        parts = [self.one(where)]
        while self.peek()[0] in ("quoted", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("sign", "("), ("sign", "^"), ("sign", "{")) or self.is_("sign", "-"):
            parts.append(self.one(where))
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def one(self, where: frozenset[str] | None) -> Node:
        if self.is_("sign", "("):
            self.take()
            out = self.either(where)
            self.take(")")
            return out
        if self.is_("sign", "-") or self.is_("sign", "{") or self.peek()[0] in ("word", "quoted") and self.peek(1) == ("sign", ":"):
            return self.one(self.narrowed(where))
        if self.is_("word", "NEAR") and self.peek(1) == ("sign", "("):
            return self.near(where)
        return Node("phrase", [self.phrase(where)])

    def narrowed(self, where: frozenset[str] | None) -> frozenset[str]:
        others = self.is_("sign", "-") and bool(self.take())
        names = []
        if self.is_("sign", "{"):
            self.take()
            while not self.is_("sign", "}"):
                names.append(self.take())
            self.take("}")
        else:
            names.append(self.take())
        self.take(":")
        if unknown := [x for x in names if x.lower() not in self.columns]:
            raise Malformed(f"no column {unknown[0]!r}")
        got = frozenset(self.columns[x.lower()] for x in names)
        got = frozenset(self.columns.values()) - got if others else got
        return got if where is None else got & where

    def near(self, where: frozenset[str] | None) -> Node:
        self.take("NEAR")
        self.take("(")
        parts, within = [], 10
        while not self.is_("sign", ")"):
            if self.is_("sign", ","):
                self.take()
                digits = self.take()
                if not digits.isdigit():
                    raise Malformed(digits)
                within = int(digits)
                break
            parts.append(self.phrase(where))
        self.take(")")
        if not parts:
            raise Malformed("NEAR()")
        return Node("near", parts, within)

    def phrase(self, where: frozenset[str] | None) -> int:
        first, terms, prefix = self.is_("sign", "^") and bool(self.take()), [], False
        while True:
            kind, text = self.peek()
            if kind not in ("word", "quoted") or kind == "word" and text in ("AND", "OR", "NOT"):
                raise Malformed(text)
            if kind == "word" and re.search(r"[^\w]", text):
                raise Malformed(text)  # such words stand in quotes
            self.take()
            terms += [x for x in re.split(r"[\W_]+", fold(text)) if x]
            if self.is_("sign", "*"):
                self.take()
                prefix = True
                break
            if not self.is_("sign", "+"):
                break
            self.take()
        self.phrases.append(Phrase(terms, prefix and bool(terms), first, where))
        return len(self.phrases) - 1


def parsed(text: str, columns: list[str]) -> tuple[Node, list[Phrase]]:
    parser = Parser(text, columns)
    if not parser.tokens:
        raise Malformed("nothing")
    return parser.whole(), parser.phrases


def wanted(phrases: list[Phrase]) -> Column:
    """Which terms some phrase asks for."""
    term = F.col("term")
    exact = sorted({t for p in phrases for i, t in enumerate(p.terms) if not (p.prefix and i == len(p.terms) - 1)})
    out = term.isin(exact) if exact else F.lit(False)
    for start in sorted({p.terms[-1] for p in phrases if p.prefix}):
        out = out | term.startswith(start)
    return out


def starts(occurrences: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(doc, length, field, phrase, at): where phrases begin, of occurrences (term, doc, field, pos, length) of their words. The words
    of a phrase meet by where it would begin, in one aggregate with partial sums."""
    asked = []
    for i, p in enumerate(phrases):
        for j, t in enumerate(p.terms):
            same = F.col("term").startswith(t) if p.prefix and j == len(p.terms) - 1 else F.col("term") == t
            if p.columns is not None:
                same = same & F.col("field").isin(sorted(p.columns))
            if p.first:
                same = same & (F.col("pos") == j)
            asked.append(F.when(same, F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("nth"))))
    each = occurrences.select("doc", "length", "field", "pos", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("a"))
    each = each.select("doc", "length", "field", F.col("a.phrase").alias("phrase"), (F.col("pos") - F.col("a.nth")).alias("at"))
    size = F.element_at(F.array(*[F.lit(len(p.terms)) for p in phrases]), F.col("phrase") + 1)
    if all(len(p.terms) == 1 for p in phrases):
        return each
    got = each.groupBy("doc", "length", "field", "phrase", "at").agg(F.count("*").alias("n"))
    return got.where(F.col("n") == size).select("doc", "length", "field", "phrase", "at")


def occurrences(df: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(term, doc, field, pos, length) of all words of some columns; length: the words of the row."""
    own = df.select(F.col(doc).alias("doc"), *[F.coalesce(words(F.col(c)), F.array().cast("array<string>")).alias(f"_{i}") for i, c in enumerate(columns)])
    length = sum((F.size(f"_{i}") for i in range(1, len(columns))), F.size("_0"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{i}").alias("said")) for i, c in enumerate(columns)])
    each = own.select("doc", length.alias("length"), F.explode(fields).alias("f"))
    return each.select("doc", F.col("f.field").alias("field"), "length", F.posexplode("f.said").alias("pos", "term")).select("term", "doc", "field", "pos", "length")


def length_of(columns: list[str]) -> Column:
    """How many words a row has."""
    return sum((F.size(F.coalesce(words(F.col(c)), F.array().cast("array<string>"))) for c in columns), F.lit(0))


def scored(found: DataFrame, node: Node, phrases: list[Phrase], n: float, total: float) -> DataFrame:
    """(doc, score) of the documents that satisfy an expression, of starts() of its phrases; n documents hold `total` words. BM25
    over the phrases: each is a word of its own."""
    places = [F.collect_list(F.struct("field", "phrase", "at")).alias("places")] if "near" in kinds(node) else []
    per = found.groupBy("doc", "length").agg(*[F.count_if(F.col("phrase") == i).alias(f"tf{i}") for i in range(len(phrases))], *places)
    having = per.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    score, average = F.lit(0.0), total / max(n, 1) or 1.0
    for i in range(len(phrases)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1.0)
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * F.col("length") / F.lit(float(average))))
    hits = per.where(holds(node, phrases)).crossJoin(F.broadcast(having))  # one row
    return hits.select("doc", rounded(score, 6).alias("score"))


def kinds(node: Node) -> set[str]:
    return {node.kind}.union(*[kinds(x) for x in node.parts if isinstance(x, Node)])


def matching(df: DataFrame, doc: str, columns: list[str], query: str) -> DataFrame:
    """(doc, score) of the rows of a table that satisfy an expression, without an index."""
    node, phrases = parsed(query, columns)
    every = occurrences(df, doc, columns)
    n, total = df.select(length_of(columns).alias("length")).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return scored(starts(every.where(wanted(phrases)), phrases), node, phrases, n, total)


def close(node: Node, phrases: list[Phrase]) -> Column:
    """Of a row's `places` (field, phrase, at): whether the phrases of a NEAR stand together somewhere."""
    first, *rest = node.parts

    def around(seed: Column, chosen: list[tuple[int, Column]], left: list[int]) -> Column:
        if not left:
            # words between the end of the first and the start of the last
            begin, last = F.least(*[c for _, c in chosen]) if len(chosen) > 1 else chosen[0][1], F.greatest(*[c for _, c in chosen]) if len(chosen) > 1 else chosen[0][1]
            end = F.lit(None)
            for i, c in chosen:
                end = F.when(c == begin, c + len(phrases[i].terms)).otherwise(end)
            return last - end <= node.within
        i = left[0]
        return F.exists("places", lambda x: (x["phrase"] == i) & (x["field"] == seed["field"]) & around(seed, [*chosen, (i, x["at"])], left[1:]))

    return F.exists("places", lambda x: (x["phrase"] == first) & around(x, [(first, x["at"])], rest))


def holds(node: Node, phrases: list[Phrase]) -> Column:
    """Whether a row with tf0, tf1, ... and places satisfies an expression."""
    if node.kind == "phrase":
        return F.col(f"tf{node.parts[0]}") > 0
    if node.kind == "near":
        return close(node, phrases)
    parts = [holds(x, phrases) for x in node.parts]
    out = parts[0]
    for x in parts[1:]:
        out = out | x if node.kind == "or" else out & ~x if node.kind == "not" else out & x
    return out
