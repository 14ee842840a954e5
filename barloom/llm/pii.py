"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how far each can be trusted, and a classifier trained on the outcome decides.

Candidates are matches of patterns. Three kinds of labelers vote yes, no or not at all: the strict form
of the kind, gazetteers (issuer ranges, calling codes, country codes, given names, top-level domains) and
the words before the span, whose absence is a no like any other. Spans of the base kinds that pass their check always stand; the classifier
adds spans of the further kinds.

Spans are found, voted on and decided by DataFrame functions. Only the number of candidates of each
combination of votes comes to the driver, which has at most ``kinds x 3^labelers`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import require
from barloom.session import cut_lineage

# The base kinds and their patterns. The look-behinds and possessive repeats start a
# match only where one can start and never step back, so that long runs cost no more than their length;
# the matches are those of
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+            of 14 to 19 digits
#   phone  \+[0-9][\x20().0-9-]+[0-9]
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Further kinds, wide patterns: the votes decide.
MORE_PATTERNS = {
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])",
    "person": r"(?<![A-Za-z])[A-Z][a-z]{1,20}+\x20[A-Z][a-z]{1,20}+(?![A-Za-z])",
}
PATTERNS = BASE_PATTERNS | MORE_PATTERNS
KINDS = list(PATTERNS)
#: What a text must hold for a pattern to match at all; only such texts are searched.
DIGIT = "_digit"
NEEDED = {"email": "@", "phone": "+", "ip": DIGIT, "card": DIGIT, "ssn": DIGIT, "iban": DIGIT, "local_phone": DIGIT}

# Gazetteers.
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan "
    "Joseph Jessica Thomas Sarah Charles Karen Maria Anna Peter Hans Klaus Petra Sabine Pierre Marie Jean "
    "Claire Jose Carmen Juan Lucia Carlos Elena"
).split()
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|se|pl|br|mx|jp|cn|in|au"
IBAN_COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"

#: What each kind's strict form and gazetteer accept, on the span's text.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$",
    "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$",
    "card": r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(?:[A-Z]{2}[0-9]{2}(?:\x20[0-9A-Z]{4}){3,7}(?:\x20[0-9A-Z]{1,3})?|[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30})$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[-.][0-9]{4}$",
    "person": r"^[A-Z][a-z]{2,}\x20[A-Z][a-z]{2,}$",
}
LISTED = {
    "email": rf"(?i)\.(?:{DOMAINS})$",
    "ip": r"^(?!0+\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0-5])",
    "phone": r"^\+(?:1|2[0-9]|3[0-69]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "ssn": r"^(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6(?:[0-57-9][0-9]|6[0-57-9])|7[0-9]{2})-",
    "iban": rf"^(?:{IBAN_COUNTRIES})",
    "local_phone": r"^\(?(?:2(?!00)|[3-8])[0-9]{2}",
    "person": rf"^(?:{'|'.join(GIVEN_NAMES)})\x20",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|account)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b",
    "ssn": r"(?i)\b(?:ssn|social security|taxpayer)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b",
    "person": r"(?:(?i)\b(?:my name is|name:|mr|mrs|ms|dr|herr|frau|signed|contact)\b\.?,?\x20?)$",
}
AGAINST = r"(?i)\b(?:version|release|isbn|invoice|order|serial|part|page|figure|table|section|chapter|license)\b"

LABELERS = ["strict", "listed", "cue", "against"]
YES, NO, SILENT = 1, 0, -1
EM_ROUNDS, FIT_ROUNDS = 50, 400
#: Values that a running fold takes at once, and characters of a block of text.
RUN, BLOCK = 128, 2048
#: Candidates that each class counts beforehand, so that a few of one class don't carry all others along.
BEFOREHAND = 20.0


@dataclass(frozen=True)
class SpanModel:
    """Log-odds per kind and per labeler's vote; ``votes[labeler]`` is (no, yes)."""

    kinds: dict[str, float]
    votes: dict[str, tuple[float, float]]


def _hits(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    needed = NEEDED.get(kind)
    if needed is None:
        return found
    may = F.col(DIGIT) if needed == DIGIT else F.contains(text, F.lit(needed))
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it and inside whatever loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column], start: Column) -> Column:
    """What ``merge`` makes of ``start`` and all values before each one, and of all, as an array one longer
    than ``values``.

    A fold that appends would copy its array at each step. Here runs of ``RUN`` values are folded by
    themselves, from where a fold over the runs before them ends.
    """

    def shifted(runs: Column, whole: Column) -> Column:
        def one(run: Column, r: Column) -> Column:
            before = F.aggregate(F.slice(whole, F.lit(1), r), start, merge)
            # The fold of a full run is the start of the next one.
            upto = F.sequence(F.lit(0), F.when(r < F.size(runs) - 1, F.size(run) - 1).otherwise(F.size(run)))
            return _let(before, lambda own: F.transform(upto, lambda i: F.aggregate(F.slice(run, F.lit(1), i), own, merge)))

        return F.flatten(F.transform(runs, one))

    def all_runs(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / RUN).cast("int")), lambda r: F.slice(v, r * RUN + 1, F.lit(RUN)))

    def folded(runs: Column) -> Column:
        return _let(F.transform(runs, lambda run: F.aggregate(run, start, merge)), lambda whole: shifted(runs, whole))

    return _let(values, lambda v: _let(all_runs(v), folded))


def _located(text: Column, hits: Column, pattern: str) -> Column:
    """Start, end (code points, exclusive), text and left context of each hit: the 40 characters before it,
    earlier hits among them.

    The pieces between the hits come from a split by the same pattern, so positions are running sums. A hit
    has five characters at least, so nine hits before one reach over its context.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def tail(x: Column) -> Column:
        return F.right(F.concat(F.right(x["piece"], F.lit(40)), x["value"]), F.lit(40))

    def spans(both: Column, ends: Column, tails: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.get(ends, i) + F.length(x["piece"])
            first = F.greatest(i - 8, F.lit(1))
            left = F.concat(F.array_join(F.slice(tails, first, i + 1 - first), ""), F.right(x["piece"], F.lit(40)))
            return F.struct(
                start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"),
                F.right(left, F.lit(40)).alias("before"),
            )

        return F.transform(both, span)

    def placed(both: Column) -> Column:
        sizes = F.transform(both, lambda x: F.length(x["piece"]) + F.length(x["value"]))
        ends = _running(sizes, lambda total, n: total + n, F.lit(0))
        return _let(ends, lambda e: _let(F.transform(both, tail), lambda t: spans(both, e, t)))

    # The last piece follows the last hit.
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    found = _let(F.arrays_zip(pieces.alias("piece"), hits.alias("value")), placed)
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _clear_of(more: Column, base: Column) -> Column:
    """Spans of ``more`` that overlap none of ``base``: both are swept by start, knowing how far the base spans
    before each one reach, and where the next one begins."""
    tagged = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("more"), s["end"].alias("end"), s.alias("own"))),
        F.transform(more, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("more"), s["end"].alias("end"), s.alias("own"))),
    )

    def kept(swept: Column) -> Column:
        reach = _running(
            F.transform(swept, lambda s: F.when(s["more"] == 0, s["end"]).otherwise(0)), lambda far, end: F.greatest(far, end), F.lit(0)
        )
        starts = F.transform(F.reverse(swept), lambda s: F.when(s["more"] == 0, s["start"]))
        following = _running(starts, lambda last, start: F.coalesce(start, last), F.lit(None).cast("int"))

        def alone(reaches: Column, nexts: Column) -> Column:
            n = F.size(swept)
            marked = F.transform(
                swept,
                lambda s, i: F.struct(
                    s["own"].alias("own"),
                    ((s["more"] == 1) & (F.get(reaches, i) <= s["start"])
                     & F.coalesce(F.get(nexts, n - 1 - i) >= s["end"], F.lit(True))).alias("keep"),
                ),
            )
            return F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: m["own"])

        return _let(reach, lambda r: _let(following, lambda f: alone(r, f)))

    return F.when((F.size(more) > 0) & (F.size(base) > 0), _let(F.array_sort(tagged), kept)).otherwise(more)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Every second digit from the right is doubled; the digit sums add up to a multiple of ten."""
    digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(
        F.filter(digits, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 9 + F.when(d == "9", 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The check of a base kind; further kinds have none."""
    if kind == "ip":
        return value.rlike(STRICT["ip"])
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _vote(kind: str, span: Column) -> list[Column]:
    def by(test: Column, yes: int, no: int) -> Column:
        return F.when(test, yes).otherwise(no)

    value, before = span["value"], span["before"]
    return [
        by(value.rlike(STRICT[kind]), YES, NO).alias("strict"),
        by(value.rlike(LISTED[kind]), YES, NO).alias("listed"),
        by(before.rlike(CUES[kind]), YES, NO).alias("cue"),
        by(before.rlike(AGAINST), NO, SILENT).alias("against"),
    ]


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_candidates`` to every row: start, end, kind, base and the votes of each candidate span.

    Base spans are the leftmost non-overlapping matches that pass their check. Candidates of the
    further kinds that touch a base span are left out. Null and empty texts have none.
    """
    held = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    held = held.withColumn(DIGIT, F.col("_text").rlike("[0-9]"))
    held = held.withColumns({f"_hits_{k}": _hits(F.col("_text"), k) for k in PATTERNS})
    held = held.withColumns({f"_at_{k}": _located(F.col("_text"), F.col(f"_hits_{k}"), p) for k, p in PATTERNS.items()})

    def voted(kind: str) -> Column:
        base = kind in BASE_PATTERNS
        passing = F.filter(f"_at_{kind}", lambda s: _passes(kind, s["value"]))
        return F.transform(
            passing,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
                F.lit(base).alias("base"), *_vote(kind, s),
            ),
        )

    held = held.withColumn("_base", F.concat(*[voted(k) for k in BASE_PATTERNS]))
    held = held.withColumn("_more", F.concat(*[voted(k) for k in MORE_PATTERNS]))
    more = _clear_of(F.col("_more"), F.col("_base"))
    return held.withColumn("_candidates", F.concat("_base", more)).select(*docs.columns, "_candidates")


def vote_counts(found: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """How many candidates there are of each kind and combination of votes, over all rows."""
    rows = (
        found.select(F.explode("_candidates").alias("s"))
        .groupBy("s.kind", *[f"s.{name}" for name in LABELERS])
        .count()
        .collect()
    )
    return [(KINDS[r.kind], tuple(r[name] for name in LABELERS), r["count"]) for r in rows]


def _reliabilities(counts: list[tuple[str, tuple[int, ...], int]]) -> list[float]:
    """Expectation-maximisation: the chance that each combination marks personal data.

    Given the truth, labelers vote independently; each has its rates of yes and no for true and false
    spans. It starts from the vote of the majority. Rates keep a weak prior that labelers are better
    than chance, which also decides which class is which.
    """
    truth = [0.5 + 0.4 * (sum(v == YES for v in votes) - sum(v == NO for v in votes)) / len(votes) for _, votes, _ in counts]
    for _ in range(EM_ROUNDS):
        total = [BEFOREHAND, BEFOREHAND]
        seen = {(name, v, z): 2.0 if v == z else 0.5 for name in LABELERS for v in (NO, YES) for z in (0, 1)}
        said = {(name, z): 2.5 for name in LABELERS for z in (0, 1)}
        for p, (_, votes, n) in zip(truth, counts, strict=True):
            for z, share in ((1, p * n), (0, (1 - p) * n)):
                total[z] += share
                for name, v in zip(LABELERS, votes, strict=True):
                    if v != SILENT:
                        seen[name, v, z] += share
                        said[name, z] += share
        prior = math.log(total[1] / total[0])
        truth = []
        for _, votes, _ in counts:
            z = prior + sum(
                math.log(seen[name, v, 1] / said[name, 1]) - math.log(seen[name, v, 0] / said[name, 0])
                for name, v in zip(LABELERS, votes, strict=True) if v != SILENT
            )
            truth.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return truth


def fit(counts: list[tuple[str, tuple[int, ...], int]]) -> SpanModel:
    """Train the span classifier, a logistic regression on kind and votes, on the estimated truth.

    The combinations stand for their spans, weighted by their share, so the work doesn't depend on the
    number of documents. Without candidates all weights are 0.
    """
    names = [("kind", k) for k in KINDS] + [(name, v) for name in LABELERS for v in (NO, YES)]
    at = {name: i for i, name in enumerate(names)}
    weights = [0.0] * len(names)
    truth, total = _reliabilities(counts), sum(n for *_, n in counts) or 1
    rows = [
        ([at["kind", kind], *(at[name, v] for name, v in zip(LABELERS, votes, strict=True) if v != SILENT)], p, n / total)
        for p, (kind, votes, n) in zip(truth, counts, strict=True)
    ]
    scale = [0.0] * len(names)
    for _ in range(FIT_ROUNDS):
        slope = [1e-4 * w for w in weights]
        for own, p, share in rows:
            z = sum(weights[i] for i in own)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * share
            for i in own:
                slope[i] += gap
        scale = [s + g * g for s, g in zip(scale, slope, strict=True)]
        weights = [w - 0.5 * g / math.sqrt(s + 1e-12) for w, g, s in zip(weights, slope, scale, strict=True)]
    return SpanModel(
        {k: weights[at["kind", k]] for k in KINDS},
        {name: (weights[at[name, NO]], weights[at[name, YES]]) for name in LABELERS},
    )


def decided(found: DataFrame, model: SpanModel) -> DataFrame:
    """Replace ``_candidates`` by ``spans``: start, end and kind of base spans and of those that the
    classifier accepts, by start and then by the order of kinds."""

    def odds(s: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(model.kinds[k]) for k in KINDS]), s["kind"] + 1)
        votes = [F.when(s[name] == YES, model.votes[name][1]).when(s[name] == NO, model.votes[name][0]).otherwise(0.0)
                 for name in LABELERS]
        return reduce(lambda a, b: a + b, votes, kind)

    kept = F.filter("_candidates", lambda s: s["base"] | (odds(s) >= 0))
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return found.withColumn("spans", F.array_sort(plain)).drop("_candidates")


def find(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``spans`` (start, kind number, end, base) to every row of ``docs``; the model is trained on the
    votes over all of them.

    Null and empty texts have no spans. Rows and other columns stay, the text unless ``keep_text`` is
    false; an existing ``spans`` is replaced. Texts are searched once: rows and candidates are written to
    the shared folder and read for the votes and for the decisions.
    """
    require(docs, [text])
    found = candidates(docs.drop("spans"), text)
    found = cut_lineage(found if keep_text else found.drop(text))
    return decided(found, fit(vote_counts(found)))


def describe(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans by the first's.

    Spans are in order. The text is cut into blocks once, and what stays between two spans is taken from the
    blocks it lies in, so the cost is that of the text and of a block for each span.
    """
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def joined(blocks: Column, reach: Column) -> Column:
        def part(first: Column, last: Column) -> Column:
            block = (first / BLOCK).cast("int")
            within = F.array_join(F.slice(blocks, block + 1, (last / BLOCK).cast("int") - block + 1), "")
            return F.substr(within, first % BLOCK + 1, last - first)

        replaced = F.transform(
            spans,
            lambda s, i: F.when(
                s["start"] >= F.get(reach, i), F.concat(part(F.get(reach, i), s["start"]), F.element_at(kinds, s["kind"] + 1))
            ),
        )
        rest = F.slice(blocks, (F.get(reach, F.size(spans)) / BLOCK).cast("int") + 1, F.size(blocks) + 1)
        after = F.substr(F.array_join(rest, ""), F.get(reach, F.size(spans)) % BLOCK + 1)
        return F.concat(F.array_join(replaced, ""), after)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = _running(F.transform(spans, lambda s: s["end"]), lambda far, end: F.greatest(far, end), F.lit(0))
    return F.when(F.size(spans) > 0, _let(blocks, lambda b: _let(reach, lambda r: joined(b, r)))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind; ``n_chars``, if there, follows."""
    clean = find(docs.drop("spans")).withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[name for name in docs.columns if name != "spans"])
