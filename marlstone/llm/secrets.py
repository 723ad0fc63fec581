"""Secret scans: a trigram inverted index finds candidates, the rule's regex verifies them.

From each rule's regex a Boolean query over trigrams is derived: alternatives, each a set of
trigrams of which a text lacks none if it matches. The rarest trigram of each alternative (by how
common its letters are) is its seed. Only texts that hold a seed have postings (trigram,
document): their lists are intersected per document, and a rule's regex then runs on its candidates
only. All other texts can match no such rule; they are read past, in a branch without a shuffle. A
rule whose regex has no mandatory trigram scans every text. Postings of trigrams that no rule names
could never be asked for, so they are not stored.

All of it is built-in expressions: the deriving of queries happens once, while planning.

Positions are code points, end exclusive. They come from ``split`` and ``regexp_extract_all`` by
the same regex, whose pieces alternate; their lengths add up to the places. Sums run over parts of
``PART`` elements, so a text with very many matches costs in proportion to them.

Defined results: a null text is the empty text, which has no span; matches of one rule do not
overlap, the leftmost first, those of different rules may; repeated rows are scanned one by one,
rows with a null id too; rules of the same name are not allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # the parser's public name goes, the module stays
    from re import _parser as _sre
except ImportError:  # pragma: no cover
    import sre_parse as _sre


@dataclass(frozen=True)
class Rule:
    """pattern: the regex, whose matches are taken leftmost and without overlaps. least: matches
    whose ``group`` is shorter are dropped afterwards. It must mean the same to Java and Python."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base rules, in their order, then the method's own.
BASE = (
    Rule("assign", "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
EXTRA = (
    Rule("forge", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

Query = frozenset[frozenset[str]]  # any of the sets, all of its trigrams; the empty set always holds
ALWAYS: Query = frozenset([frozenset()])
_MOST = 64


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must hold, as alternatives of trigram sets, if ``pattern`` matches."""
    words, query = _of_sequence(_sre.parse(pattern))
    return query if words is None else _meet(query, _of_words(words))


def _of_words(words: set[str]) -> Query:
    return _absorbed(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)


def _absorbed(sets) -> Query:
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=lambda x: (len(x), sorted(x))):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept)


def _meet(a: Query, b: Query) -> Query:
    return _absorbed(x | y for x, y in product(a, b))


def _of_sequence(items) -> tuple[set[str] | None, Query]:
    """The words that the items can be, if few, else None with what they require."""
    words, query, whole = {""}, ALWAYS, True
    for op, arg in items:
        own, needed = _of_item(str(op), arg)
        if own is not None and len(words) * len(own) <= _MOST:
            words = {a + b for a, b in product(words, own)}
            continue
        query, whole = _meet(query, _of_words(words)), False
        words = own if own is not None else {""}
        query = _meet(query, needed)
    return (words, query) if whole else (None, _meet(query, _of_words(words)))


def _of_item(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower()}, ALWAYS
    if op == "IN":
        chars = {chr(v).lower() for o, v in arg if str(o) == "LITERAL"}
        return (chars, ALWAYS) if all(str(o) == "LITERAL" for o, _ in arg) and len(chars) <= 4 else (None, ALWAYS)
    if op == "SUBPATTERN":
        return _of_sequence(arg[3])
    if op == "BRANCH":
        parts = [_of_sequence(x) for x in arg[1]]
        if all(w is not None for w, _ in parts) and sum(len(w) for w, _ in parts) <= _MOST:
            return set().union(*(w for w, _ in parts)), ALWAYS
        return None, _absorbed(s for w, q in parts for s in (_of_words(w) if w is not None else q))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        words, query = _of_sequence(inner)
        if words is not None and least == 0 and most == 1:
            return words | {""}, ALWAYS
        if words is not None and least == most and len(words) ** least <= _MOST:
            return {"".join(x) for x in product(words, repeat=least)}, ALWAYS
        return None, ALWAYS if least == 0 else _of_words(words) if words is not None else query
    return None, ALWAYS  # anchors and all else require nothing


#: Letters, the most common ones of English first; all else is rarer.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"


def seeds(query: Query) -> set[str]:
    """The rarest trigram of each alternative."""
    rarity = lambda t: sum(_COMMON.find(c) if c in _COMMON else len(_COMMON) for c in t)
    return {max(sorted(s), key=rarity) for s in query}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``key, trigram``: a row for each of the trigrams (by number) that a document's ``low`` holds."""
    present = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return docs.select("key", F.explode(F.array_compact(present)).alias("trigram"))


def candidates(docs: DataFrame, asked: dict[str, Query]) -> DataFrame:
    """``key`` and, for each query, whether it holds (``can_<name>``)."""
    trigrams = sorted({t for q in asked.values() for s in q for t in s})
    number = {t: i for i, t in enumerate(trigrams)}
    words = range(0, len(trigrams), 60)  # met as bits, 60 to a long
    bits = [F.bit_or(F.when(F.col("trigram").between(k, k + 59), F.expr(f"shiftleft(1L, trigram - {k})")).otherwise(F.lit(0).cast("long"))).alias(f"bits_{k}") for k in words]

    def holds(s: frozenset[str]) -> Column:
        out = F.lit(True)
        for k in words:
            mask = sum(1 << (number[t] - k) for t in s if k <= number[t] < k + 60)
            if mask:
                out &= F.col(f"bits_{k}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long")
        return out

    def any_of(q: Query) -> Column:
        out = F.lit(False)
        for s in sorted(q, key=sorted):
            out |= holds(s)
        return out

    met = postings(docs, trigrams).groupBy("key").agg(*bits)
    return met.select("key", *[any_of(q).alias(f"can_{name}") for name, q in asked.items()])


#: Elements of a part of ``running``.
PART = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs, all before it joined by an associative ``join``, 0 before the
    first. An array grows by copying it, so it is made of parts of ``PART`` elements."""
    empty = F.expr("cast(array() as array<bigint>)")
    zero = F.lit(0).cast("long")

    def prefixes(some: Column, start: Column) -> Column:
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        return F.aggregate(some, F.struct(start.alias("at"), empty.alias("all")), step, lambda s: s["all"])

    def of(some: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / PART).cast("int")), lambda k: F.slice(some, k * PART + 1, F.lit(PART)))
        return bound(parts, lambda p: F.flatten(F.zip_with(p, prefixes(F.transform(p, lambda c: F.aggregate(c, zero, join)), zero), prefixes)))

    return F.when(F.size(numbers) > 0, bound(numbers, of)).otherwise(empty)


SPANS = "array<struct<start:int,kind:int,end:int>>"
_NO_SPANS = f"cast(array() as {SPANS})"


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """The rule's spans in ``text``: an array of (start, kind, end), kind being ``number``."""
    pattern = F.lit(rule.pattern)
    found, sized = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # what stands before each match, its length and that of its group; behind the last match there is none
    pieces = F.zip_with(F.zip_with(F.split(text, rule.pattern, -1), found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size"))), sized, lambda x, g: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(g).alias("held")))

    def spans(own: Column) -> Column:
        before = running(F.transform(own, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))), lambda a, b: a + b)
        placed = F.zip_with(own, before, lambda x, at: F.struct((at + x["gap"]).cast("int").alias("start"), F.lit(number).alias("kind"), (at + x["gap"] + x["size"]).cast("int").alias("end"), x["held"].alias("held")))
        return F.transform(F.filter(placed, lambda x: x["held"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(rule.pattern), bound(pieces, spans)).otherwise(F.expr(_NO_SPANS))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = (), mask: str | None = None) -> DataFrame:
    """``id_col``, the columns ``keep``, and ``spans``: array of (start, kind, end), by start and
    then by the rules' order; kind is the rule's number in ``rules``.

    mask: also gives ``masked``, the text (null stays null) with that in place of each span."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need names of their own")
    kept = [f"_keep_{i}" for i in range(len(keep))]
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(text_col).isNull().alias("no_text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    asked = {r.name: q for r in rules if (q := trigram_query(r.pattern)) != ALWAYS}
    wanted = sorted(set().union(*map(seeds, asked.values()))) if asked else []
    low = F.lower("text")
    seeded = F.lit(False)
    for seed in wanted:
        seeded |= F.contains(low, F.lit(seed))

    def scanned(rows: DataFrame) -> DataFrame:
        spans = [F.when(F.col(f"can_{r.name}"), rule_spans(F.col("text"), r, i)).otherwise(F.expr(_NO_SPANS)) if f"can_{r.name}" in rows.columns else rule_spans(F.col("text"), r, i) for i, r in enumerate(rules) if r.name not in asked or f"can_{r.name}" in rows.columns]
        return rows.select("id", "text", "no_text", *kept, F.array_sort(F.concat(F.expr(_NO_SPANS), *spans)).alias("spans"))

    quiet = own.where(~seeded)
    found = scanned(quiet)
    if wanted:
        # texts of one key are looked at in any case, so that equal keys of different rows do no harm
        loud = own.where(seeded).withColumn("key", F.xxhash64("id", "text"))
        met = candidates(loud.select("key", low.alias("low")), asked)
        # by hash, so that the texts need no sort
        found = found.unionByName(scanned(loud.join(met.hint("shuffle_hash"), "key")))
    hidden = [F.when(~F.col("no_text"), masked(F.col("text"), F.col("spans"), mask)).alias("masked")] if mask is not None else []
    return found.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "spans", *hidden)


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as text, ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mask``."""

    def gaps(codes: Column) -> Column:
        """The texts between spans. ``codes`` has four bytes a code point, so each is cut out directly."""
        cut = lambda start, end: F.decode(F.substring(codes, (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int")), "UTF-32")
        latest = running(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b))
        # a span that begins inside an earlier one has no text before it
        before = F.zip_with(spans, latest, lambda s, at: F.when(s["start"] >= at, cut(at, s["start"])))
        last = F.array_max(F.transform(spans, lambda s: s["end"].cast("long")))
        return F.concat(F.array_compact(before), F.array(cut(last, F.length(codes) / 4)))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(bound(F.encode(text, "UTF-32"), gaps), mask))
