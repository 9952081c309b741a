"""Mixing sources to target weights by hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import BLANK, SALTS, WORD, cut, free_name

#: The tree: a document's domain holds its language, which holds its source.
LEVELS = ("domain", "lang", "source")
#: Leaves up to this many are broadcast; with more, rows meet their leaf by a join that deals each leaf over SALTS tasks.
BROADCAST_LEAVES = 50_000
#: Rows among which a leaf's budget ends that one task sorts at most.
SORTED_ROWS = 100_000
ABSENT = "(none)"
#: What mix() adds to the caller's columns, and what it uses on the way.
OUT = ("domain", "epoch", "tokens", "take_tokens")
BETWEEN = ("lang", "source", "q", "rest", "cut_key", "cut_take", "salt", "key", "copies")


def default_domain(source: Column) -> Column:
    """Three domains by the last digit of the source's name: 0-3 web, 4-7 books, the rest code."""
    digit = F.substring(source, -1, 1)
    return F.when(digit.isin("0", "1", "2", "3"), F.lit("web")).when(digit.isin("4", "5", "6", "7"), F.lit("books")).otherwise(F.lit("code"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space between as it was."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{BLANK}]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def order_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """The place of a document in its leaf's epoch: MD5 of seed, epoch, id and the text's MD5.  Only rows with the same
    id and text share it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def weight_of(level: str, name: Column, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The integer weight of a node among its siblings, 1 where none is stated."""
    stated = weights.get(level, {})
    out = F.lit(1).cast("long")
    for node, weight in stated.items():
        out = F.when(name == node, F.lit(int(weight)).cast("long")).otherwise(out)
    return out


def names(columns: Sequence[str]) -> dict[str, str]:
    """The columns that mix() adds to a table with these: _domain, _epoch, _tokens and _take_tokens, with a number after
    a name that the table has itself."""
    out: dict[str, str] = {}
    for name in (*OUT, *BETWEEN):
        out[name] = free_name(f"_{name}", [*columns, *out.values()])
    return out


def share(nodes: DataFrame, parent: Sequence[str], name: str, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Give each parent's `budget` to its children by weight, none above its `cap`; what one can't take goes to its siblings.

    In order of cap / weight the children that fill up come first, so the level at which the others stand follows from
    running sums: no loop.  All arithmetic is on integers (decimal(38,0)); shares round down, and the rest of that goes
    one each to the first children, in the same order, that aren't full.
    """
    big = lambda c: c.cast("decimal(38,0)")
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rising = siblings.orderBy(F.col("cap").cast("double") / F.col("w"), F.col(name))
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = (
        nodes.withColumn("w", weight_of(name, F.col(name), weights))
        .filter("w > 0")
        .withColumn("_left", big(F.col("budget")) - F.coalesce(F.sum(big(F.col("cap"))).over(before), big(F.lit(0))))
        .withColumn("_w", F.sum("w").over(onward))
        .withColumn("_full", F.expr("cast(cap as decimal(38,0)) * _w <= cast(w as decimal(38,0)) * _left"))
        .withColumn("_r", F.row_number().over(rising))
        .withColumn("_at", F.min(F.when(~F.col("_full"), F.struct(F.col("_r").alias("r"), F.col("_left").alias("l"), F.col("_w").alias("w")))).over(siblings))
    )
    out = out.withColumn("_base", F.when(~F.col("_full"), F.expr("cast((cast(w as decimal(38,0)) * _at.l) div cast(_at.w as decimal(38,0)) as bigint)")))
    rest = F.col("_at.l") - F.sum(big(F.col("_base"))).over(siblings)
    one = F.when(F.col("_r") - F.col("_at.r") < F.col("_rest"), 1).otherwise(0)
    out = out.withColumn("_rest", rest).withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("_base") + one)))
    return out.drop("w", "_left", "_w", "_full", "_r", "_at", "_base", "_rest")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `budget`: the total taken down the tree level by level.

    A node's cap is what its leaves hold in max_epochs epochs, so a shortage goes to the nodes beside it and, only
    when they are full as well, shows as its parent's cap, to be made up one level higher.  Leaves below a node of
    weight 0 can take nothing: they count in no cap, and aren't returned.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    for level in LEVELS:
        caps = caps.filter(weight_of(level, F.col(level), weights) > 0)
    tier = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", total)
    tier = share(tier, (), "domain", weights).select("domain", F.col("share").alias("budget"))
    tier = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(tier, "domain")
    tier = share(tier, ("domain",), "lang", weights).select("domain", "lang", F.col("share").alias("budget"))
    tier = caps.join(tier, ["domain", "lang"])
    return share(tier, ("domain", "lang"), "source", weights).select(*LEVELS, "tokens", F.col("share").alias("budget"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    fraction: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """docs' rows as often as the mixture takes them, with _domain, _epoch, _tokens and _take_tokens (see names: every
    column of docs stays, whatever it is called).

    The budget is fraction of all tokens (words).  A leaf whose budget is q whole epochs and a rest takes each of its
    documents q times, and in epoch q the prefix of its seeded order that fills the rest; of the document that crosses
    the budget _take_tokens counts the words that still fit, and it is returned whole.  Rows with one id and text
    stand at one place and are taken together.

    Epoch q's order is cut into 256 buckets by the first two digits of the key; running sums over buckets find the one
    that crosses, which is cut again by the next digits while it has more than SORTED_ROWS rows.  Only the last one's
    rows are sorted, so that no leaf, however hot, meets in one task.  Which rows are taken is then decided row by row
    against a table of leaves, and texts aren't shuffled up to BROADCAST_LEAVES leaves.

    Null source, language or domain: the child "(none)".  Documents without words fill no budget: they are taken where
    their leaf's prefix passes their place.  A node of weight 0 takes nothing.  Empty table: no rows.
    """
    put = names(docs.columns)
    place = domain if domain is not None else default_domain(F.col(source_col))
    tagged = docs.withColumns(
        {
            put["domain"]: F.coalesce(place, F.lit(ABSENT)),
            put["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit(ABSENT)),
            put["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit(ABSENT)),
            put["tokens"]: word_count(F.col(text_col)),
        }
    )
    ids, text = F.col(id_col), F.col(text_col)
    narrow = cut(
        tagged.select(*(F.col(put[c]).alias(c) for c in LEVELS), F.col(put["tokens"]).alias("n"), *(order_key(seed, F.lit(e), ids, text).alias(f"k{e}") for e in range(max_epochs))),
        "leaves",
    )
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    whole = leaves.agg(F.coalesce(F.floor(F.sum("tokens") * F.lit(fraction[0]) / F.lit(fraction[1])), F.lit(0)).cast("long").alias("_total"))
    given = budgets_of(leaves, whole, weights, max_epochs)
    given = cut(
        given.withColumn("q", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("q") * F.col("tokens")),
        "budgets",
    )
    small = given.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda t: t)
    crossing = cut(boundaries(narrow, given, hint, max_epochs), "crossing")
    cuts = given.join(crossing, list(LEVELS), "left").select(*(F.col(c).alias(put[c]) for c in (*LEVELS, "q", "rest", "cut_key", "cut_take")))
    leaf = [put[c] for c in LEVELS]
    if small:
        met = tagged.join(F.broadcast(cuts), leaf)
    else:
        salt = F.pmod(F.xxhash64(ids, text), F.lit(SALTS)).cast("int")
        met = tagged.withColumn(put["salt"], salt).join(cuts.withColumn(put["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*leaf, put["salt"]])
    at = {name: F.col(column) for name, column in put.items()}
    met = met.withColumn(put["key"], F.when((at["rest"] > 0) & (at["q"] < max_epochs), order_key(seed, at["q"], ids, text)))
    partial = F.coalesce(at["key"] <= F.coalesce(at["cut_key"], F.lit("g")), F.lit(False))
    met = met.withColumn(put["copies"], at["q"] + partial.cast("int")).filter(at["copies"] > 0)
    out = met.withColumn(put["epoch"], F.explode(F.sequence(F.lit(0), at["copies"] - 1)))
    ends = (at["epoch"] == at["q"]) & (at["key"] == at["cut_key"])
    out = out.withColumn(put["take_tokens"], F.when(ends, F.least(at["tokens"], at["cut_take"])).otherwise(at["tokens"]))
    return out.select(*docs.columns, *(put[c] for c in OUT))


def budgets_of(leaves: DataFrame, whole: DataFrame, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """budgets() with the total taken from the one row of `whole`."""
    total = whole.first()["_total"]
    return budgets(leaves, F.lit(total).cast("long"), weights, max_epochs)


def boundaries(narrow: DataFrame, given: DataFrame, hint, max_epochs: int, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """(domain, lang, source, cut_key, cut_take): where the rest of each leaf's budget ends in its epoch q."""
    keys = F.array(*(F.col(f"k{e}") for e in range(max_epochs)))
    last = narrow.join(hint(given.filter(f"rest > 0 and q < {max_epochs}").select(*LEVELS, "q", "rest")), list(LEVELS)).select(*LEVELS, "rest", "n", F.get(keys, F.col("q")).alias("key"))
    leaf = Window.partitionBy(*LEVELS)
    inside = last.withColumn("_before", F.lit(0).cast("long"))
    for digits in range(2, 33, 2):
        bucket = F.substring("key", 1, digits).alias("bucket")
        sums = inside.groupBy(*LEVELS, "rest", "_before", bucket).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        upto = F.col("_before") + F.coalesce(F.sum("n").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("_upto", upto).filter("_upto < rest and _upto + n >= rest").select(*LEVELS, "bucket", F.col("_upto").alias("_before"), "rows")
        crossing = cut(found, f"crossing-{digits}", narrow=True)
        inside = last.withColumn("bucket", F.substring("key", 1, digits)).join(hint(crossing.drop("rows")), [*LEVELS, "bucket"])
        if (crossing.agg(F.max("rows")).first()[0] or 0) <= sorted_rows:
            break
    rows = inside.groupBy(*LEVELS, "rest", "_before", "key").agg(F.sum("n").alias("n"))
    upto = F.col("_before") + F.coalesce(F.sum("n").over(leaf.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_upto", upto).filter("_upto < rest and _upto + n >= rest").select(*LEVELS, F.col("key").alias("cut_key"), (F.col("rest") - F.col("_upto")).alias("cut_take"))
