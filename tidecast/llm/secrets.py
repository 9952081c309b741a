"""Secret scans: stated patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stated patterns and the least length of what they catch.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy")
#: Candidate strings, the window that slides over them, and the least entropy in bits by character class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: The characters of candidates; one's place here is its number.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts stand in words of 64 bits, PACKED of BITS bits to a word: a window of fewer than 2 ** BITS characters.
BITS, PACKED = 5, 12
THRESHOLDS = {"hex": 3.0, "base64": 3.7, "letters": 4.1}
#: Candidates suppressed whatever their entropy: UUIDs, paths and slugs of words, runs of the alphabet or the digits, and placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[/_-]*(?:[A-Za-z]?[a-z]+[/_-]+)+[A-Za-z]?[a-z]*$",
    r"(?i)example|placeholder|changeme|abcdefghij|0123456789|1234567890|xxxxxxxx",
)

#: Entries that a running sum appends to one array at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over the first i + 1 of an array of longs, for each i; op is associative and 0 changes nothing.

    Prefixes are taken within blocks, then over the blocks, so that an array of n costs n * BLOCK appends at most.
    """

    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(op(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(op(acc["s"], x))).alias("out")), lambda acc: acc["out"])

    def over(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v), F.lit(BLOCK)), lambda at: at < F.size(v))
        return let(F.transform(starts, lambda at: fold(F.slice(v, at + 1, BLOCK))), joined_blocks)

    def joined_blocks(blocks: Column) -> Column:
        tops = fold(F.transform(blocks, lambda block: F.element_at(block, -1)))
        return let(tops, lambda top: F.flatten(F.transform(blocks, lambda block, i: F.transform(block, lambda x: op(F.coalesce(F.get(top, i - 1), F.lit(0).cast("long")), x)))))

    return let(values, over)


def found(text: Column, pattern: str, kind: int) -> Column:
    """The matches of pattern in text as (start, kind, end, match), leftmost and not overlapping, in code points.

    split() cuts at the very matches that regexp_extract_all() returns, so running sums over both give the offsets.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def located(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
        return F.zip_with(
            hits,
            running(lengths, lambda a, b: a + b),
            lambda hit, end: F.struct((end - F.length(hit)).cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), hit.alias("match")),
        )

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(none)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def char_class(candidate: Column) -> Column:
    """hex, letters or base64 (letters and digits or marks)."""
    return (
        F.when(F.regexp_like(candidate, F.lit(r"^(?:[0-9a-f]+|[0-9A-F]+)$")), F.lit("hex"))
        .when(F.regexp_like(candidate, F.lit(r"^[A-Za-z]+$")), F.lit("letters"))
        .otherwise(F.lit("base64"))
    )


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of `window` consecutive characters of a candidate, in one pass.

    The counts of the window's characters are kept from step to step, packed in a few words, and so is the sum of
    c * log2(c): each step takes the character that leaves out and the one that enters in.  Entropy is log2(window)
    less sum / window.  Null for fewer characters than a window.  All characters must be of SYMBOLS.
    """
    words = -(-len(SYMBOLS) // PACKED)
    terms = F.array(*(F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 1)))
    none = F.lit(0).cast("long")

    def held(counts: Column, symbol: Column) -> Column:
        word = F.get(counts, F.floor(symbol / PACKED).cast("int"))
        return F.call_function("shiftright", word, F.pmod(symbol, F.lit(PACKED)) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def unit(symbol: Column, word: Column) -> Column:
        """What one character adds to a word of counts."""
        return F.when(F.floor(symbol / PACKED) == word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(symbol, F.lit(PACKED)) * BITS)).otherwise(none)

    def step(acc: Column, move: Column) -> Column:
        out, into = move["leaves"], move["enters"]
        leaving, staying = held(acc["counts"], out), held(acc["counts"], into) - F.when(out == into, 1).otherwise(0)
        gone = F.when(out >= 0, F.get(terms, leaving - 1) - F.get(terms, leaving)).otherwise(F.lit(0.0))
        total = acc["total"] + gone - F.get(terms, staying) + F.get(terms, staying + 1)
        counts = F.transform(acc["counts"], lambda word, i: word - F.when(out >= 0, unit(out, i)).otherwise(none) + unit(into, i))
        # -2: the first window isn't whole yet
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(out > -2, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    def scanned(symbols: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(-2), window - 1), F.array(F.lit(-1)), F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - window, F.lit(0))))
        moves = F.zip_with(symbols, before, lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves")))
        start = F.struct(F.array_repeat(none, words).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("least"))
        return F.aggregate(moves, start, step, lambda acc: F.log2(F.lit(float(window))) - acc["least"] / F.lit(float(window)))

    characters = F.filter(F.split(candidate, ""), lambda ch: F.length(ch) == 1)
    return F.when(F.length(candidate) >= window, let(F.transform(characters, lambda ch: F.instr(F.lit(SYMBOLS), ch) - 1), scanned))


def is_secret(candidate: Column) -> Column:
    """Whether a candidate passes its class's threshold and no allow-list pattern suppresses it.

    Strings of letters only must mix cases, those of class base64 must hold a digit.
    """
    kind = char_class(candidate)
    least = F.when(kind == "hex", F.lit(THRESHOLDS["hex"])).when(kind == "letters", F.lit(THRESHOLDS["letters"])).otherwise(F.lit(THRESHOLDS["base64"]))
    shape = (
        F.when(kind == "letters", F.regexp_like(candidate, F.lit("[a-z][A-Z].*[a-z][A-Z]")))
        .when(kind == "hex", F.regexp_like(candidate, F.lit("[a-fA-F]")) & F.regexp_like(candidate, F.lit("[0-9]")))
        .otherwise(F.regexp_like(candidate, F.lit("[0-9]")))
    )
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.regexp_like(candidate, F.lit(pattern))
    return F.when(shape & ~allowed, peak_entropy(candidate) >= least).otherwise(F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra): each document's spans by the stated patterns, and those that entropy adds.

    A span is (start, kind, end) in code points, end exclusive; kinds are numbered as in KINDS.  An entropy span is a
    whole candidate string that overlaps no base span.  All of it is one narrow step: no shuffle, whatever the skew.
    Null or empty text: no spans.  Repeated rows: each has its own spans.  Other columns are ignored.
    """
    t = F.col("_t")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    value = lambda s: F.length(F.regexp_replace(s["match"], F.lit(ASSIGN_HEAD), F.lit("")))
    located = plain.select(
        "doc_id",
        F.filter(found(t, ASSIGN, 0), lambda s: value(s) >= ASSIGN_LEAST).alias("assign"),
        found(t, ACCESS, 1).alias("access"),
        found(t, HEX, 2).alias("hex"),
        found(t, CANDIDATE, 3).alias("cand"),
    )
    base = located.select("doc_id", F.array_sort(F.concat(_bare(F.col("assign")), _bare(F.col("access")), _bare(F.col("hex")))).alias("base"), "cand")
    extra = F.when(F.size("cand") > 0, F.filter(apart(F.col("cand"), F.col("base")), lambda c: is_secret(c["match"]))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>"))
    return base.select("doc_id", "base", _bare(extra).alias("extra"))


def apart(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap no span.

    Both are put in one order, spans by their start and candidates by their end; a candidate overlaps one where the
    furthest end of the spans before it in that order lies past its start.
    """
    marks = lambda rows, at, kind, match: F.transform(rows, lambda r: F.struct(r[at].alias("at"), F.lit(kind).alias("span"), r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), match(r).alias("match")))
    events = F.array_sort(F.concat(marks(candidates, "end", 0, lambda r: r["match"]), marks(spans, "start", 1, lambda r: F.lit(""))))

    def told(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: F.when(x["span"] == 1, x["end"]).otherwise(F.lit(0)).cast("long")), F.greatest)
        kept = F.filter(F.zip_with(e, reach, lambda x, r: F.struct(x.alias("x"), (r <= x["start"]).alias("free"))), lambda p: (p["x"]["span"] == 0) & p["free"])
        return F.transform(kept, lambda p: F.struct(p["x"]["start"].alias("start"), p["x"]["kind"].alias("kind"), p["x"]["end"].alias("end"), p["x"]["match"].alias("match")))

    return let(events, told)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, id_col, text_col).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
