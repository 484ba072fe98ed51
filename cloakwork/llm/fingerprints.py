"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

A text's lines are cut into pieces of ``WORDS`` words. The k-th occurrence of a
piece is an element of its own, with a 64-bit key: 42 bits of hash and 22 check
bits that follow from them. A sketch has four subtables of four cells; each key
is put into one cell of each, which takes the XOR of its keys.

Sketches are linear, so two versions' cells subtract (by XOR), and what both hold
is gone. A cell left with one key (its check bits tell) gives that key up; taking
it out of its other cells frees more of them, until the differing keys are all
recovered or no such cell is left. Then a larger sketch is tried: a hash deals the
keys of both versions among parts of 16 cells, ``LOAD`` keys for each; after that
each part that failed is split in ``SPLIT``, with other cells for each key, until
none fails. How many of the recovered keys either version holds follows from
their number and from those of the versions' elements.

The fingerprint is the small sketch. The likeness of two versions is the number
of elements that both hold over that of those that either holds.

Texts cross one exchange, by blocks of neighbouring doc_ids. A document's next one
is the row after it in its block, and each block holds the first document of the
block after it too. All that follows works on rows dealt by block, without an
exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, whole_text

WORDS = 20
PIECE = rf"\S++(?:[^\S\n]++\S++){{0,{WORDS - 1}}}"
TABLES, CELLS = 4, 4
CHECK_BITS = 22
SPLIT, ROUNDS = 2, 12
#: Elements of both versions for each of the larger sketches: of a text and its edited form about half are expected to differ.
LOAD = {"e": 12, "x": 6}
#: Documents of a block on average, and blocks at most: their first doc_ids are all that reaches the driver.
BLOCK_ROWS, MAX_BLOCKS = 1024, 1 << 16
VERSIONS = ("a", "b", "n")  # the text, its edited form, the next document's text


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(key: Column) -> Column:
    """The check bits that belong to a key's hash bits."""
    return F.shiftrightunsigned(F.xxhash64(F.shiftrightunsigned(key, CHECK_BITS)), 64 - CHECK_BITS)


def _key(hashed: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(hashed, CHECK_BITS), CHECK_BITS)
    return high.bitwiseOR(_check(high))


def keys(text: Column) -> Column:
    """The keys of a text's elements, in no order, none twice."""

    def numbered(s: Column) -> Column:
        """Keys from sorted hashes: each run of equal ones is counted from 1."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        runs = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(at) - 1), F.array(F.size(s))), lambda a, end: F.transform(F.sequence(F.lit(1), end - a), lambda k: _key(F.xxhash64(F.get(s, a), k))))
        return F.flatten(_let(starts, runs))

    def keyed(d: Column) -> Column:
        apart = F.transform(d, lambda x: _key(F.xxhash64(x, F.lit(1))))
        return F.when(F.size(F.array_distinct(d)) == F.size(d), apart).otherwise(_let(F.sort_array(d), numbered))

    return _let(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)), keyed)


def _at(key: str, table: int) -> str:
    """A key's cell in a subtable."""
    return f"(shiftrightunsigned({key}, {61 - 3 * table}) & {CELLS - 1})"


def sketch_columns(key: str, name: str = "c", of: str = "true") -> list[Column]:
    """Aggregates: the cells of a group's keys, of those that a condition selects."""
    return [F.bit_xor(F.expr(f"IF({of} AND {_at(key, t)} = {c}, {key}, 0L)")).alias(f"{name}{CELLS * t + c}") for t in range(TABLES) for c in range(CELLS)]


def cells(name: str = "c") -> list[str]:
    return [f"{name}{i}" for i in range(TABLES * CELLS)]


def peel(sketch: Column) -> Column:
    """(got, whole): how many keys a subtracted sketch (an array of cells) gives up, and whether nothing is left."""
    long = lambda n: F.lit(n).cast("bigint")
    place = lambda k, t: F.shiftrightunsigned(k, 61 - 3 * t).bitwiseAND(long(CELLS - 1)).cast("int") + CELLS * t
    mask = lambda k: reduce(Column.bitwiseOR, [F.call_function("shiftleft", long(1), place(k, t)) for t in range(TABLES)])
    has = lambda at, i: F.call_function("shiftrightunsigned", at, i).bitwiseAND(long(1)) == 1

    def turn(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (c != 0) & (_check(c) == c.bitwiseAND(long((1 << CHECK_BITS) - 1))))
        keys = F.transform(F.array_distinct(pure), lambda k: F.struct(k.alias("k"), mask(k).alias("at")))
        return F.when(state["live"], _let(keys, lambda keys: taken(state, keys))).otherwise(state)

    def taken(state: Column, keys: Column) -> Column:
        rest = lambda c, i: F.aggregate(keys, c, lambda a, k: F.when(has(k["at"], i), a.bitwiseXOR(k["k"])).otherwise(a))
        left = F.struct((state["got"] + F.size(keys)).alias("got"), F.lit(True).alias("live"), F.transform(state["cells"], rest).alias("cells"))
        ended = F.struct(state["got"].alias("got"), F.lit(False).alias("live"), state["cells"].alias("cells"))
        return F.when(F.size(keys) > 0, left).otherwise(ended)

    start = F.struct(F.lit(0).alias("got"), F.lit(True).alias("live"), sketch.alias("cells"))
    ended = lambda s: F.struct(s["got"].alias("got"), F.forall(s["cells"], lambda c: c == 0).alias("whole"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, ended)


def _packed(name: str) -> str:
    """A sketch's cells as bytes."""
    return "unhex(concat({}))".format(", ".join(f"lpad(hex({c}), 16, '0')" for c in cells(name)))


@contextmanager
def _kept_partitioning(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made here tell how their rows are dealt, and joins make use of it; an adaptive plan would not tell."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _first_ids(ids: DataFrame) -> list[int]:
    """Ascending doc_ids, each the first of a block of neighbours; the first is the smallest of all."""
    blocks = min(MAX_BLOCKS, max(1, ids.count() // BLOCK_ROWS))
    ranges = min(blocks, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = -(-blocks // ranges)
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / each) for i in range(1, each + 1)]), 100 * each)
    found = ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first"), cuts.alias("cuts")).collect()
    return sorted({x for row in found for x in (row.first, *row.cuts[:-1])})


def _block(doc_id: Column, firsts: Column, n: int) -> Column:
    """The number (from 1) of the block of a doc_id, by binary search."""
    steps = [1 << s for s in reversed(range((n - 1).bit_length()))]
    if not steps:
        return F.lit(1)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(1), lambda at, step: F.when((at + step <= n) & (F.get(firsts, at + step - 1) <= doc_id), at + step).otherwise(at))


def edited_versions(documents: DataFrame) -> DataFrame:
    """(block, rn, doc_id, text, keys, after, edited) of the rows with a doc_id, dealt by block; rn tells a block's rows apart.

    ``after`` holds doc_id, text and keys of the next document; ``edited`` is the
    text with its last quarter replaced by as much of that text's beginning.
    """
    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"))
    firsts = _first_ids(texts.select("doc_id"))
    n, listed = max(1, len(firsts)), F.split(F.lit(",".join(map(str, firsts)) or "0"), ",").cast("array<bigint>")
    own = texts.withColumn("block", _block(F.col("doc_id"), listed, n))
    here = F.struct(F.col("block").alias("block"), F.lit(0).alias("guest"))
    before = F.struct((F.pmod(F.col("block") - 2, F.lit(n)) + 1).alias("block"), F.lit(1).alias("guest"))
    is_first = F.get(listed, F.col("block") - 1) == F.col("doc_id")
    placed = own.select("doc_id", "text", F.inline(F.when(is_first, F.array(here, before)).otherwise(F.array(here))))
    parts = min(n, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 16))
    dealt = placed.repartition(parts, "block").select("block", "guest", "doc_id", "text", F.xxhash64("text").alias("h"))
    keyed = dealt.select("*", F.inline(F.array(F.struct(keys(F.col("text")).alias("keys")))))
    order = Window.partitionBy("block").orderBy("guest", "doc_id", "h")
    led = keyed.select("block", "guest", "doc_id", "text", "keys", F.row_number().over(order).alias("rn"), F.lead(F.struct("guest", "doc_id", "text", "keys")).over(order).alias("lead"))
    # Rows that share a doc_id all get what follows the last of them.
    last = F.when((F.col("lead.doc_id") != F.col("doc_id")) | (F.col("lead.guest") == 1), F.col("lead"))
    after = led.withColumn("after", F.max(last).over(Window.partitionBy("block", "guest", "doc_id"))).where("guest = 0")
    edited = F.expr("concat(substring(text, 1, length(text) - floor(length(text) / 4)), substring(after.text, 1, cast(floor(length(text) / 4) as int)))")
    return after.select("block", "rn", "doc_id", "text", "keys", "after", edited.alias("edited"))


def _keyed(documents: DataFrame) -> DataFrame:
    """A row a document (block, rn): its figures and the keys of the three versions."""
    versions = edited_versions(documents)
    made = F.inline(F.array(F.struct(F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), keys(F.col("edited")).alias("b"))))
    return versions.select("block", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.col("keys").alias("a"), F.col("after.keys").alias("n"), made)


PAIR = ["block", "rn", "pair"]


def _small(keyed: DataFrame) -> DataFrame:
    """(block, rn, pair, f, got, whole) from the small sketches of the three versions, for documents with any key.

    Pair e is the text and its edited form, x the text and the next text; f is
    the text's sketch in the row of e and the edited form's in that of x.
    """
    tag = lambda i: lambda k: F.struct(F.lit(i).alias("v"), k.alias("k"))
    put = keyed.select("block", "rn", F.inline(F.concat(*[F.transform(v, tag(i)) for i, v in enumerate(VERSIONS)])))
    each = put.groupBy("block", "rn").agg(*[c for i, v in enumerate(VERSIONS) for c in sketch_columns("k", v, f"v = {i}")])
    less = lambda v: ", ".join(f"{a} ^ {b}" for a, b in zip(cells("a"), cells(v), strict=True))
    rows = [f"named_struct('pair', '{p}', 'f', {_packed(of)}, 'cells', array({less(v)}))" for p, of, v in (("e", "a", "b"), ("x", "b", "n"))]
    return each.selectExpr("block", "rn", f"inline(array({', '.join(rows)}))").select(*PAIR, "f", F.inline(F.array(peel(F.col("cells")))))


def _larger(keyed: DataFrame, tried: DataFrame) -> DataFrame:
    """(block, rn, pair, got): how many keys differ in the pairs that small sketches left, from parts of larger sketches.

    A pair's keys are dealt among parts by a hash; each part is a sketch whose
    cells take the keys of both versions, which is their difference.
    """
    done, failed, turn = None, tried.where("NOT whole").select(*PAIR), 0
    while not failed.isEmpty():
        asked = failed.groupBy("block", "rn").agg(F.collect_set("pair").alias("which"))
        both = keyed.select("block", "rn", *VERSIONS).join(asked, ["block", "rn"])
        of = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(LOAD[p]).alias("load"), F.concat("a", v).alias("keys")) for p, v in (("e", "b"), ("x", "n"))])
        rows = both.select("block", "rn", F.inline(F.filter(of, lambda s: F.array_contains("which", s["pair"]))))
        rows = rows.select(*PAIR, F.ceil(F.size("keys") / F.col("load")).alias("size"), F.explode("keys").alias("k"))
        home = lambda r: F.pmod(F.xxhash64("k", F.lit(4)), F.col("size") * F.lit(SPLIT**r))
        if turn:
            rows = rows.withColumn("home", home(turn - 1)).join(failed, [*PAIR, "home"], "left_semi")
        put = rows.select(*PAIR, home(turn).alias("home"), _key(F.xxhash64("k", F.lit(5 + turn))).alias("k"))
        sketches = put.groupBy(*PAIR, "home").agg(*sketch_columns("k"))
        got = shared_checkpoint(sketches.select(*PAIR, "home", F.inline(F.array(peel(F.array(*cells()))))))
        own = got.where("whole").select(*PAIR, "got")
        done = own if done is None else done.unionByName(own)
        failed, turn = got.where("NOT whole").select(*PAIR, "home"), turn + 1
    return tried.where("false").select(*PAIR, "got") if done is None else done


def _compared(keyed: DataFrame) -> DataFrame:
    """(__block, __rn, fa, fb, got_e, got_x) of documents with any key."""
    tried = shared_checkpoint(_small(keyed))
    got = tried.where("whole").select(*PAIR, "got").unionByName(_larger(keyed, tried))
    each = got.withColumn("f", F.lit(None).cast("binary")).unionByName(tried.select(*PAIR, F.lit(0).alias("got"), "f"))
    of = lambda p, c: F.when(F.col("pair") == p, F.col(c))
    sums = [F.sum(of(p, "got")).alias(f"got_{p}") for p in ("e", "x")]
    return each.groupBy(F.col("block").alias("__block"), F.col("rn").alias("__rn")).agg(*sums, F.max(of("e", "f")).alias("fa"), F.max(of("x", "f")).alias("fb"))


def _likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """What both hold against what either holds, from the numbers of elements and of those that one of the two holds."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differing) / (n_a + n_b + differing))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document's text; the next larger doc_id
    is next, the smallest after the largest (a lone document: itself). near_*
    are likenesses from 0 to 1 of the text to its edited form and to the next
    document's text; texts without a piece (null, empty, blank) are alike and
    have the empty sketch. Rows with the same doc_id have the same next
    document; of several texts of a next document the one with the smallest
    hash counts. A row without a doc_id has no place in the order: all but its
    n_chars is null. Other columns are ignored; an empty table gives an empty
    result. All rows of one doc_id are in one task, which sorts them.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with _kept_partitioning(documents.sparkSession):
        keyed = shared_checkpoint(_keyed(source))
        compared = shared_checkpoint(_compared(keyed))
    meta = keyed.select("block", "rn", "doc_id", "n_chars", "edited_sha256", *[F.size(v).alias(f"n_{v}") for v in VERSIONS])
    whole = meta.join(compared, (F.col("block") == F.col("__block")) & (F.col("rn") == F.col("__rn")), "left")
    empty = F.lit(b"\0" * (8 * TABLES * CELLS))
    differing = lambda p: F.coalesce(f"got_{p}", F.lit(0))
    out = whole.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.base64(F.coalesce("fa", empty)).alias("fingerprint"),
        F.base64(F.coalesce("fb", empty)).alias("edited_fingerprint"),
        _likeness(F.col("n_a"), F.col("n_b"), differing("e")).alias("near_edited"),
        _likeness(F.col("n_a"), F.col("n_n"), differing("x")).alias("near_next"),
    )
    nameless = source.where(F.col("doc_id").isNull()).select("doc_id", F.length(whole_text()).cast("long").alias("n_chars"))
    return out.unionByName(nameless, allowMissingColumns=True)
