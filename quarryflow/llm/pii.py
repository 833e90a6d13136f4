"""Personal data by pattern, checksum and context, in DataFrame functions only.

Patterns propose spans, validators (Luhn for cards, mod 97 for IBANs, ranges for addresses) confirm them and words
within ``REACH`` characters adjust a score. Spans of the base patterns stay whatever their score; the method's own
spans need ``THRESHOLD``: numbers that a base pattern swallowed whole together with a neighbour, short cards, written
out mail addresses, long network addresses, IBANs, social security numbers and access keys. Words of the lowering kind
drop a span of any kind, and those that start below the threshold need a raising one.

Positions come without a scan per match: the texts between matches and the matches themselves alternate, so running
sums of their lengths are the spans, and the ends of the gaps are the context. A text is cut once by each pattern that
it may hold, running values come from those of runs of ``RUN`` matches, and overlaps from a search in sorted spans.
Patterns are written so that a failed start is never tried again inside the same run of characters. So long texts and
texts of very many matches take time in proportion.

Defined cases: a null or empty text has no spans; repeated rows are answered one by one; a null doc_id is
kept; other columns are ignored (``redact`` returns them as they came). Positions count code points, ends
exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
REACH, THRESHOLD = 40, 60
#: Matches whose running values share a start, and characters of a text that are cut out together.
RUN, BLOCK = 128, 512

_START = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
#: kind -> (texts that must occur, cheap pattern, pattern). Possessive forms of the base patterns: they match the same spans.
BASE = {
    "email": (("@",), "", _START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ((".",), r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ((), r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (("+",), "", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: (kind, texts that must occur, cheap pattern, pattern) of the method's own proposals.
MORE = (
    ("email", (), r"[(\[]at[)\]]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++"),
    ("ip", (":",), r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])"),
    ("card", (), r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9])(?:[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19}+)(?![0-9])"),
    ("phone", ("+",), "", r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("iban", (), r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", ("-",), r"[0-9]-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
    ("secret", ("AKIA",), "", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", ("=",), "", r"(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_key)=[^\s]{6,}"),
)
#: kind -> (score of a confirmed match in hundredths, words that raise it, words that lower it).
CONTEXT = {
    "email": (60, "mail|contact|write", "noreply|example"),
    "ip": (60, "ip|host|server|address", "version|release|build"),
    "card": (70, "card|visa|credit|amex|master|payment", "order|serial|tracking|isbn"),
    "phone": (70, "phone|tel|call|mobile|fax|contact", "order|serial|part"),
    "iban": (70, "iban|bank|account|bic", "serial|sample"),
    "ssn": (40, "ssn|social|security|tax", "order|serial|part"),
    "secret": (70, "key|secret|password|token|aws", "sample|placeholder"),
}
RAISED = 20

_SPAN = "struct<kind:string,start:int,end:int,score:int>"


def luhn(number: Column) -> Column:
    """Whether a number's digits pass: every second digit from the right doubled, its digits summed."""
    digits = F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0))

    def part(c: Column, k: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(k % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.transform(digits, part), F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's rearranged number leaves 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    codes = F.transform(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda rest, c: F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)) == 1


def _confirmed(kind: str, base: bool, m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "ip" and base:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(n.between(16 if base else 13, 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _kept(column: str, result: Column) -> Column:
    """``result`` where the column is not null. Two uses of a column keep the planner from putting what makes it into a
    lambda, where it would be made again for each element."""
    return F.when(F.col(column).isNotNull(), result)


def _settled(df: DataFrame, columns: list[Column], **made: Column) -> DataFrame:
    """``columns`` and what is made, as the rows of a generator: filters on it stay above and do not copy what makes it."""
    rows = df.select(*columns, F.explode_outer(F.array(F.struct(*(x.alias(c) for c, x in made.items())))).alias("_made"))
    return rows.select(*rows.columns[:-1], *(F.col("_made")[c].alias(c) for c in made))


def _running(df: DataFrame, columns: list[str], op: Callable[[Column, Column], Column]) -> tuple[DataFrame, list[Callable[[Column], Column]]]:
    """More columns, and from them for each of ``columns``, arrays, a value of ``op`` over all elements before a place."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: op(a, b))

    def of(c: str) -> Column:
        count = F.floor((F.size(c) + (RUN - 1)) / RUN).cast("int")
        return _kept(c, F.transform(F.sequence(F.lit(0), count), lambda r: fold(F.slice(c, r * RUN + 1, RUN)))).alias(f"{c}_of")

    def upto(c: str) -> Column:
        return _kept(f"{c}_of", F.transform(f"{c}_of", lambda _, r: fold(F.slice(f"{c}_of", F.lit(1), r)))).alias(f"{c}_upto")

    def before(c: str) -> Callable[[Column], Column]:
        run = lambda k: F.floor(k / RUN).cast("int")
        return lambda k: op(F.get(F.col(f"{c}_upto"), run(k)), fold(F.slice(c, run(k) * RUN + 1, k - run(k) * RUN)))

    return df.select("*", *map(of, columns)).select("*", *map(upto, columns)), [before(c) for c in columns]


def _judged(kind: str, base: bool, gaps: Column, matches: Column) -> Column:
    """Of each match of a pattern: the length of the gap before it, its own, and its score (null: not confirmed)."""
    start, good, bad = CONTEXT[kind]

    def judged(pair: Column, after: Column) -> Column:
        before, m = pair["before"], pair["m"]
        words = F.lower(F.concat(F.right(before, F.lit(REACH)), F.lit(" "), F.left(after, F.lit(REACH))))
        raised = F.when(words.rlike(rf"\b(?:{good})"), RAISED).otherwise(0) - F.when(words.rlike(rf"\b(?:{bad})"), RAISED).otherwise(0)
        score = F.when(_confirmed(kind, base, m), F.lit(start) + raised)
        return F.struct(F.length(before).alias("before"), F.length(m).alias("size"), score.alias("score"))

    n = F.size(matches)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), n), matches, lambda g, m: F.struct(g.alias("before"), m.alias("m")))
    return F.when(matches.isNotNull(), F.zip_with(pairs, F.slice(gaps, F.lit(2), n), judged))


def _spans(kind: str, base: bool, each: str, sizes: str, before: Callable[[Column], Column]) -> Column:
    """The spans of a pattern that count, from what ``_judged`` gives."""

    def span(x: Column, k: Column) -> Column:
        begin = before(k) + x["before"]
        ok = x["score"].isNotNull() if base else x["score"] >= THRESHOLD
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + x["size"]).alias("end"), x["score"].alias("score")))

    found = F.filter(F.transform(each, span), lambda x: x.isNotNull())
    return F.coalesce(_kept(each, _kept(f"{sizes}_upto", found)), F.array().cast(f"array<{_SPAN}>"))


def _may(text: Column, any_cheap: Column, literals: tuple[str, ...], cheap: str, pattern: str) -> Column:
    """Whether a text holds a match: told by one search after the cheap tests, in their order."""
    may = text.rlike(pattern)
    if cheap:
        may = F.when(any_cheap & text.rlike(cheap), may).otherwise(False)
    for x in literals:
        may = F.when(F.contains(text, F.lit(x)), may).otherwise(False)
    return may


def _apart(own: Column, base: Column) -> Column:
    """The own spans that overlap none of the base spans of their kind, which are sorted and do not overlap themselves."""

    def clear(x: Column) -> Column:
        def halve(state: Column, _: Column) -> Column:  # how many base spans begin before the own one ends
            middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
            less = F.get(base, middle)["start"] < x["end"]
            open_ = state["low"] < state["high"]
            return F.struct(
                F.when(open_ & less, middle + 1).otherwise(state["low"]).alias("low"), F.when(open_ & ~less, middle).otherwise(state["high"]).alias("high")
            )

        n = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(base)))), F.struct(F.lit(0).alias("low"), F.size(base).alias("high")), halve, lambda s: s["low"])
        return F.coalesce(F.get(base, n - 1)["end"] <= x["start"], F.lit(True))

    return F.when((F.size(own) > 0) & (F.size(base) > 0), F.filter(own, clear)).otherwise(own)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of (kind, start, end, score), by kind as listed, then start."""
    columns = docs.columns
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rules = [(kind, True, *rule) for kind, rule in BASE.items()] + [(kind, False, *rule) for kind, *rule in MORE]
    # columns of their own, each used more than once, so that the planner does not put a cut into what is done per match
    any_cheap = column.rlike("|".join(sorted({cheap for *_, cheap, _ in rules if cheap})))
    may = docs.withColumn("_cheap", any_cheap).select("*", *(_may(column, F.col("_cheap"), *rule).alias(f"_may{k}") for k, (_, _, *rule) in enumerate(rules)))
    cut = may.select(*columns, *(
        x for k, (*_, pattern) in enumerate(rules) for may in (F.col(f"_may{k}"),)
        for x in (F.when(may, F.split(column, pattern, -1)).alias(f"_gaps{k}"), F.when(may, F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias(f"_matches{k}"))
    ))
    each = cut.select(*columns, *(_judged(kind, base, F.col(f"_gaps{k}"), F.col(f"_matches{k}")).alias(f"_each{k}") for k, (kind, base, *_) in enumerate(rules)))
    sized = each.select("*", *(_kept(f"_each{k}", F.transform(f"_each{k}", lambda x: x["before"] + x["size"])).alias(f"_sizes{k}") for k in range(len(rules))))
    sized, before = _running(sized, [f"_sizes{k}" for k in range(len(rules))], lambda a, b: a + b)
    found = sized.select(*columns, *(_spans(kind, base, f"_each{k}", f"_sizes{k}", before[k]).alias(f"_spans{k}") for k, (kind, base, *_) in enumerate(rules)))
    of = {kind: F.col(f"_spans{k}") for k, kind in enumerate(BASE)}
    own = [_apart(F.col(f"_spans{k}"), of[kind]) if kind in BASE else F.col(f"_spans{k}") for k, (kind, base, *_) in enumerate(rules) if not base]
    return _settled(found, [F.col(c) for c in columns], base=F.concat(*of.values()), more=F.concat(*own))


def _sorted(spans: Column) -> Column:
    order = F.create_map(*(F.lit(x) for k in enumerate(KINDS) for x in reversed(k)))
    keyed = F.transform(spans, lambda x: F.struct(order[x["kind"]].alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op1_pii(docs: DataFrame) -> DataFrame:
    """The contract's columns, and ``scores``: those of ``spans``, in the same order."""
    found = detect(docs.select("doc_id", "text")).withColumn("every", _sorted(F.concat("base", "more")))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("every", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    found = detect(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text")
    by_start = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    whole = F.col("_text")
    found = found.select("_row", "_text", F.when(F.size("base") + F.size("more") > 0, by_start).alias("_spans"))
    found, (high,) = _running(found.withColumn("_ends", _kept("_spans", F.transform("_spans", lambda x: x["end"]))), ["_ends"], F.greatest)
    found = found.withColumn("_high", _kept("_ends_upto", F.transform("_ends", lambda _, k: high(k))))
    # a span that begins where all before it have ended begins a cut, which ends where the spans before the next cut do
    first = F.filter(F.sequence(F.lit(0), F.size("_spans") - 1), lambda k: F.get(F.col("_spans"), k)["start"] >= F.get(F.col("_high"), k))
    found = found.withColumn("_first", _kept("_high", first))

    def cut(k: Column, i: Column) -> Column:
        x, stop = F.get(F.col("_spans"), k), F.coalesce(F.get(F.col("_high"), F.get(F.col("_first"), i + 1)), F.array_max("_ends"))
        return F.struct(x["start"].alias("start"), stop.alias("end"), x["kind"].alias("kind"))

    found = found.withColumn("_cuts", _kept("_first", F.transform("_first", cut))).select("_row", "_text", "_cuts")
    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    found = found.select("*", F.when(F.col("_cuts").isNotNull(), blocks).alias("_blocks"))
    cuts = F.col("_cuts")

    def between(begin: Column, stop: Column) -> Column:
        first, last = F.floor(begin / BLOCK).cast("int"), F.floor((stop - 1) / BLOCK).cast("int")
        joined = F.array_join(F.slice("_blocks", first + 1, last - first + 1), "")
        return F.when(stop <= begin, "").otherwise(F.substring(joined, begin - first * BLOCK + 1, stop - begin))

    def piece(x: Column, k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(cuts, k - 1)["end"])
        return F.concat(between(begin, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))

    changed = F.concat(F.array_join(F.transform(cuts, piece), ""), between(F.element_at(cuts, -1)["end"], F.length(whole)))
    new = F.when(cuts.isNotNull(), changed).otherwise(whole)
    return _settled(found, [F.col("_row")], new=new).select(*(F.col("new").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
