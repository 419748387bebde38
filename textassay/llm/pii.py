"""Personal data by weak supervision, with DataFrame functions only.

Labelers vote on candidate spans, expectation-maximisation estimates how far each
labeler can be trusted, and a classifier is trained on the resulting soft labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# The kinds, in the order in which their spans are listed.
KINDS = ["email", "ip", "card", "phone"]

_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the base patterns: a run that does not lead to a match is
#: given up whole, so no text takes more than linear time or deep recursion.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must contain before a pattern is tried.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Gazetteers and cue words of the labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING = r"^\+(?:1|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
RESERVED = r"^(?:0|10|127|255|192\.168)\."
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|address|from|login)",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|konto|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|contact)",
}
COUNTER_CUES = r"(?i)(?:version|isbn|order|serial|section|figure|\bid\b|\bno\.)[^\n]{0,12}$"
CONTEXT = 40  # characters before a span that the context labeler reads

LABELERS = ["format", "gazetteer", "context", "check", "border"]
FEATURES = [*LABELERS, "length", "parted"]
ROUNDS = 40


def _located(text: Column, hits: Column, pattern: str) -> Column:
    """``array<struct<start, hit>>``: start places from the lengths of what is between hits."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(hits), F.lit(1)))
    pairs = F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("out")
    )

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        return F.struct(
            (start + F.char_length(pair["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), pair["hit"].alias("hit")))).alias("out"),
        )

    found = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, found).otherwise(
        F.array().cast("array<struct<start:int,hit:string>>")
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string has a valid check digit."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, hit: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _counts(kind: str) -> Callable[[Column], Column]:
    return lambda found: _valid(kind, found["hit"])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _gazetteer(kind: str, hit: Column) -> Column:
    if kind == "email":
        return _vote(hit.rlike(rf"(?i)(?:\.|dot[\])]\x20?)(?:{DOMAINS})$"), F.lit(True))
    if kind == "ip":
        return _vote(~hit.rlike(RESERVED), F.lit(True))
    if kind == "card":
        return _vote(_digits(hit).rlike(ISSUERS), F.lit(True))
    return _vote(hit.rlike(CALLING) | hit.rlike(r"^\(?[2-9][0-9]{2}"), F.lit(True))


def _check(kind: str, hit: Column) -> Column:
    if kind == "card":
        return _vote(luhn(_digits(hit)), F.lit(True))
    if kind == "phone":
        return _vote(F.length(_digits(hit)).between(9, 15), F.lit(True))
    if kind == "ip":
        return _vote(hit.contains(":") | _valid("ip", hit), F.lit(True))
    return _vote(F.char_length(hit) <= 80, F.lit(True))


def _described(text: Column, kind: str, base: bool) -> Callable[[Column], Column]:
    """A located hit as a candidate: span, votes (0 no, 1 abstains, 2 yes) and features."""

    def describe(found: Column) -> Column:
        start, hit = found["start"], found["hit"]
        stop = start + F.char_length(hit)
        first = F.greatest(start - CONTEXT, F.lit(0))
        before = text.substr(first + 1, start - first)
        after = text.substr(stop + 1, F.lit(1))
        touching = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
        size = F.char_length(hit)
        values = {
            "format": F.lit(2 if base else 1),
            "gazetteer": _gazetteer(kind, hit),
            "context": _vote(before.rlike(CUES[kind]), before.rlike(COUNTER_CUES)),
            "check": _check(kind, hit),
            "border": _vote(~touching, F.lit(True)),
            "length": F.when(size < 12, 0).when(size < 20, 1).otherwise(2),
            "parted": F.when(hit.rlike(r"[\x20()]"), 1).otherwise(0),
        }
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.alias("start"),
            stop.alias("stop"),
            F.lit(base).alias("base"),
            *[values[name].cast("int").alias(name) for name in FEATURES],
        )

    return describe


def add_candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """``docs`` with an array of candidate spans, sorted by kind and start.

    A candidate is a base match that counts, or a looser match (digits that look
    like a card but fail the check, a spelt-out address, a number without its
    country) that no base match overlaps. Starts and stops are code points. Null and
    empty texts have none. A column ``name`` that is there already is replaced.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(name)
    empty = F.array().cast("array<string>")
    places = []
    for tag, patterns in (("b", BASE), ("l", LOOSE)):
        for kind, pattern in patterns.items():
            hits, at = f"_pii_{tag}h_{kind}", f"_pii_{tag}_{kind}"
            need = _NEEDS[kind] if tag == "b" else ""
            guard = full.contains(need) if need else full.rlike("[0-9]" if kind != "email" else r"[\[(](?:at|AT)")
            out = out.withColumn(
                hits, F.when(guard, F.regexp_extract_all(full, F.lit(pattern), F.lit(0))).otherwise(empty)
            )
            places.append((tag, kind, pattern, hits, at))
    out = out.withColumns({at: _located(full, F.col(hits), p) for _, _, p, hits, at in places})
    base, loose = [], []
    for tag, kind, _, _, at in places:
        described = _described(full, kind, tag == "b")
        if tag == "l":
            loose.append(F.transform(F.col(at), described))
        else:
            good = F.filter(F.col(at), _counts(kind))
            base.append(F.transform(good, described))
            if kind == "card":
                bad = F.filter(F.col(at), lambda x: ~_valid("card", x["hit"]))
                loose.append(F.transform(bad, _described(full, kind, False)))
    out = out.withColumns({"_pii_base": F.concat(*base), "_pii_loose": F.concat(*loose)})
    free = F.filter(
        F.col("_pii_loose"),
        lambda x: ~F.exists("_pii_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])),
    )
    out = out.withColumn(name, F.sort_array(F.concat("_pii_base", free)))
    helpers = [c for place in places for c in place[3:]]
    return out.drop(*helpers, "_pii_base", "_pii_loose")


@dataclass(frozen=True)
class SpanModel:
    """For each kind a bias and a weight per feature value, in log odds; and the labelers' reliabilities."""

    bias: tuple[float, ...]
    weights: tuple[tuple[tuple[float, ...], ...], ...]
    reliability: tuple[tuple[float, ...], ...]

    def accepts(self, candidate: Column) -> Column:
        """Base matches always, others by the sign of the classifier's log odds."""
        odds = F.get(F.array(*map(F.lit, self.bias)), candidate["kind"])
        for i, name in enumerate(FEATURES):
            table = F.array(
                *[F.array(*[F.lit(v) for v in kind[i]]) for kind in self.weights]
            )
            odds = odds + F.get(F.get(table, candidate["kind"]), candidate[name])
        return candidate["base"] | (odds > 0)


def _em(rows: list[Row]) -> tuple[dict[tuple, float], list[float]]:
    """Posterior of each vote pattern, and how often each labeler that votes is right.

    Labelers are independent given the truth. The first posterior is the share of yes votes.
    """
    counts: dict[tuple, float] = {}
    for row in rows:
        pattern = tuple(row[name] for name in LABELERS)
        counts[pattern] = counts.get(pattern, 0) + row["count"]
    voted = {p: [v for v in p if v != 1] for p in counts}
    post = {p: (sum(v == 2 for v in vs) + 0.5) / (len(vs) + 1) for p, vs in voted.items()}
    total = sum(counts.values())
    table = []
    for _ in range(ROUNDS):
        prior = (sum(counts[p] * post[p] for p in counts) + 1) / (total + 2)
        table = []
        for i in range(len(LABELERS)):
            yes, no = [1.0] * 3, [1.0] * 3
            for p, n in counts.items():
                yes[p[i]] += n * post[p]
                no[p[i]] += n * (1 - post[p])
            table.append(([v / sum(yes) for v in yes], [v / sum(no) for v in no]))
        for p in counts:
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(t[0][v] / t[1][v]) for t, v in zip(table, p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    right = []
    for i in range(len(LABELERS)):
        good = sum(n * (post[p] if p[i] == 2 else 1 - post[p]) for p, n in counts.items() if p[i] != 1)
        right.append(good / max(1e-9, sum(n for p, n in counts.items() if p[i] != 1)))
    return post, right


def fit(found: DataFrame, name: str = "candidates") -> SpanModel:
    """A model from all candidates of the table.

    Candidates are counted by kind, votes and features: the driver gets at most 4 * 3**5 * 6
    counts, whatever the table. Without candidates of a kind its model accepts
    no loose match.
    """
    flat = found.select(F.explode(name).alias("c")).select("c.kind", *[f"c.{f}" for f in FEATURES])
    rows = flat.groupBy("kind", *FEATURES).count().collect()
    bias, weights, reliability = [], [], []
    for kind in range(len(KINDS)):
        own = sorted((r for r in rows if r["kind"] == kind), key=tuple)
        post, right = _em(own) if own else ({}, [0.0] * len(LABELERS))
        soft = [(r, r["count"], post[tuple(r[n] for n in LABELERS)]) for r in own]
        yes = sum(n * p for _, n, p in soft)
        no = sum(n * (1 - p) for _, n, p in soft)
        bias.append(math.log((yes + 1) / (no + 1)) if own else -1.0)
        columns = []
        for feature in FEATURES:
            column = []
            for value in range(3):
                a = 1 + sum(n * p for r, n, p in soft if r[feature] == value)
                b = 1 + sum(n * (1 - p) for r, n, p in soft if r[feature] == value)
                column.append(math.log(a / (yes + 3)) - math.log(b / (no + 3)))
            columns.append(tuple(column))
        weights.append(tuple(columns))
        reliability.append(tuple(right))
    return SpanModel(tuple(bias), tuple(weights), tuple(reliability))


def accepted(model: SpanModel, name: str = "candidates") -> Column:
    """The candidates that the model takes for personal data."""
    return F.filter(F.col(name), model.accepts)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"]))
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], between, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(
        ordered, zero, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
