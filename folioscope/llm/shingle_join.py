"""Near-duplicate components by a grouped prefix join over word shingles.

A document's set holds the 64-bit names of its shingles; documents with equal
sets take part once. Sets are ordered by one global order, common shingles last
(those seen often in a slice of the input, by total count; a heuristic list of
bounded size, which decides cost and never results), so two sets that link must
share a token of their short prefixes.

Blocks ask which tokens of a somewhat longer prefix another set holds, too. A set
with fewer shared ones than any link needs goes no further; of the others the
shared prefix tokens are kept. Sets with identical prefixes and size form a
group, which stands in the token lists once. Then, for each token and size band,
every group is tried against one leading group (the one with most shared tokens,
so the original rather than one of its altered copies), and every member against
its group's first; this is done LEADERS times, later with leaders from outside
the token's largest component. A round makes no more pairs than there are rows,
and joins a crowd of near copies without trying all its pairs.

What is left are tokens whose groups hold different components. Two sets alone with
a token are tried. Where there are more, of like size, members are expanded and written as differences from the token's leader L: what a set has
beyond L, then what it lacks of L. Two sets differ by as much as their differences
do, so a link must be seen in a prefix join of the differences, where what all
copies share is gone and what a copy has of its own comes first; pairs pass the
size and position bounds and are verified on the sets. Two sets so near L that
their differences need not meet are both linked with L itself. Pairs inside one
component need no trial, as only components are reported; no link between
different components is lost.

Defined results: null text or text without words has an empty set, links with
nothing and is its own component; a null doc_id has a null component. Repeated
rows and equal texts share a set. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import meet, mix, question, read_answer, word_names
from .common import fresh, scratch, slices, text_buffer, tidy, written
from .components import components

WORDS = 4
THRESHOLD = 85  # per cent
#: Shingles on the list of common ones, and how often one must occur in a slice to be counted for it.
COMMON, COMMON_IN_SLICE = 1 << 17, 4
#: Tokens asked for beyond the prefix, in per cent of a set. A set with fewer shared tokens than that can't link and goes no further.
SURE = 10
#: Rounds in which each token's groups are tried against one leader.
LEADERS = 2
#: Sets that a leader has at most if they are tried inside the join.
FEW = 64
_STEP = np.uint64(0x9FB21C651E98DF25)


def _case_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


_LOWER = _case_table()
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and start and size of each word; words end at the bounds at."""
    lower = _LOWER[data]
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))
    last = solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))
    start = np.flatnonzero(first)
    return lower, start, np.flatnonzero(last) + 1 - start


def shingle_sets(data: np.ndarray, at: np.ndarray, n_words: int) -> list[np.ndarray]:
    """The sorted names of the distinct shingles of each text data[at[i]:at[i+1]]."""
    lower, start, size = words(data, at)
    named = word_names(lower, start, size)
    bounds = np.searchsorted(start, at)
    rolled = np.zeros(len(named), np.uint64)
    for k in range(min(n_words, len(named))):
        rolled[: len(named) - k] = rolled[: len(named) - k] * _STEP + named[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n_words:
            out.append(np.unique(rolled[a : b - n_words + 1]))
        elif b > a:
            whole = b - a
            for x in named[a:b].tolist():
                whole = (whole * int(_STEP) + x) & ((1 << 64) - 1)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> bytes:
    """A 128-bit digest of a set, which stands for it."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed(n: int, threshold: int) -> int:
    """The fewest shingles that a set of n shares with any set it links with."""
    return -(-threshold * n // 100)


def prefix_size(n: int, threshold: int) -> int:
    return n - needed(n, threshold) + 1


def sure(n: int) -> int:
    """How many of the first prefix_size(n) + sure(n) - 1 tokens a set that links shares with others: it misses n - needed(n) at most."""
    return max(1, n * SURE // 100)


class Order:
    """The global order: names ascending, the common ones (given commonest first) after all others, the commonest last."""

    def __init__(self, common: np.ndarray) -> None:
        self.sorted = np.sort(common)
        self.rank = -np.argsort(common, kind="stable")

    def prefix(self, s: np.ndarray, threshold: int) -> np.ndarray:
        """The prefix that any linking set shares a token of, and SURE per cent of the set's tokens more."""
        return self.first(s, prefix_size(len(s), threshold) + sure(len(s)) - 1)

    def first(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first n of the sorted names s."""
        if not len(self.sorted):
            return s[:n]
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        common = self.sorted[at] == s
        rare = s[~common]
        if len(rare) >= n:
            return rare[:n]
        rest = s[common]
        return np.concatenate([rare, rest[np.argsort(self.rank[at[common]], kind="stable")]])[:n]


def _catalogue(rows: DataFrame, n_words: int) -> DataFrame:
    """A row (block, doc_id, n, id) for each document and a row (name, n) for each shingle common in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(*text_buffer(part.column("text")), n_words)
            seen, count = np.unique(np.concatenate(sets), return_counts=True)
            often = count >= COMMON_IN_SLICE
            k, m = len(sets), int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([part.column("block"), pa.nulls(m, pa.int32())]),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([[len(s) for s in sets], count[often]]).astype(np.int64)),
                    pa.array([set_id(s) for s in sets] + [None] * m, pa.binary()),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(seen[often].view(np.int64))]),
                ],
                ["block", "doc_id", "n", "id", "name"],
            )

    return rows.mapInArrow(tidy(run), "block int, doc_id long, n long, id binary, name long")


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the sorted names p are in q."""
    return q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p


def _alike(n: int, m: int, same: int, threshold: int) -> bool:
    return 100 * same >= threshold * (n + m - same)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) of set ids, those whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                good.append(_alike(len(p), len(q), int(_shared(p, q).sum()), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def most_apart(n: int, m: int, threshold: int) -> int:
    """The most tokens in which two sets of n and m that link differ."""
    return (100 - threshold) * (n + m) // (100 + threshold)


def _differences(led: DataFrame, sets: DataFrame, order: Callable[[], "Order"], threshold: int) -> DataFrame:
    """For each (id, leader): n, whether the two link, how many tokens they differ in, and the first of these.

    Any order of tokens that holds for all sets of a leader will do. What a set
    has beyond the leader comes first, as few other sets have it.
    """
    left = sets.select("id", "set")
    right = sets.select(F.col("id").alias("leader"), F.col("set").alias("lead"))
    both = led.join(right, "leader").join(left, "id").select("id", "leader", "set", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = order()
        for batch in batches:
            sizes, linked, apart, tokens = [], [], [], []
            for x, y in zip(batch.column("set"), batch.column("lead"), strict=True):
                s, lead = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                more, less = s[~_shared(s, lead)], lead[~_shared(lead, s)]
                sizes.append(len(s))
                linked.append(_alike(len(s), len(lead), len(s) - len(more), threshold))
                apart.append(len(more) + len(less))
                n = most_apart(len(s), 100 * len(s) // threshold, threshold) + 1
                tokens.append(np.concatenate([own.first(more, n), own.first(less, n)])[:n].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("leader"), pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(apart, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["id", "leader", "n", "linked", "apart", "tokens"])

    return both.mapInArrow(tidy(run), "id binary, leader binary, n long, linked boolean, apart long, tokens array<long>")


def _near(differences: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of sets of different components whose differences from one leader may be near enough for a link.

    A leader of at most FEW sets tries each of those outside its largest
    component on the others inside the join, where differences must be about as
    large and share a token of their prefixes; of more sets, only those meet that
    have such a token.
    """
    # Of sets of n and m that are apart and o_apart from a leader, a link holds (slack + o_slack) / 2 / (100 + threshold) tokens of both differences.
    slack = (100 + threshold) * F.col("apart") - (100 - threshold) * F.col("n")
    placed = differences.join(members.select("id", "comp"), "id").withColumn("slack", slack)
    sizes = placed.groupBy("leader", "comp").agg(F.min("slack").alias("least"), F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("leader").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all"), F.min("least").alias("least")).where("comps > 1").select("leader", F.col("m.comp").alias("main"), "all", "least")
    odd_least = sizes.join(main.select("leader", "main"), "leader").where("comp <> main").groupBy("leader").agg(F.min("least").alias("o_least"))
    mixed = placed.join(main.withColumnRenamed("least", "any_least").join(odd_least, "leader"), "leader").withColumn("odd", F.col("comp") != F.col("main"))
    shared = F.ceil((F.col("slack") + F.when(F.col("odd"), F.col("any_least")).otherwise(F.col("o_least"))) / (2 * (100 + threshold)))
    first = F.least(F.col("apart") - shared + 1, F.size("tokens")).cast("int")
    mixed = mixed.withColumn("first", first).where("first > 0")
    rows = written(mixed.select("leader", "id", "n", "apart", "comp", "odd", F.slice("tokens", F.lit(1), F.col("first")).alias("tokens"), (F.col("all") <= FEW).alias("few")), "shingle-mixed")

    def other(df: DataFrame, *columns: str) -> DataFrame:
        return df.where("odd").select("leader", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "apart", "comp")], *columns)

    size = F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * threshold
    may = (F.col("comp") != F.col("o_comp")) & (~F.col("odd") | (F.col("id") < F.col("o_id"))) & size
    few, many = rows.where("few"), rows.where("not few").select("leader", "id", "n", "apart", "comp", "odd", F.posexplode("tokens").alias("place", "token"))
    alike = F.abs(F.col("apart") - F.col("o_apart")) * (100 + threshold) <= (F.col("n") + F.col("o_n")) * (100 - threshold)
    one = few.join(other(few, F.col("tokens").alias("o_tokens")), "leader").where(may & alike & F.arrays_overlap("tokens", "o_tokens"))
    most = F.least(F.col("apart") - F.col("place"), F.col("o_apart") - F.col("o_place"))
    meets = (2 * most - F.col("apart") - F.col("o_apart")) * (100 + threshold) + (F.col("n") + F.col("o_n")) * (100 - threshold) >= 0
    two = many.join(other(many, F.col("place").alias("o_place"), "token"), ["leader", "token"]).where(may & meets)
    pair = (F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
    return one.select(*pair).unionByName(two.select(*pair)).distinct()


def _may_link(n1: str, p1: str, n2: str, p2: str, threshold: int) -> F.Column:
    """The size bound, and the most that two sets can share that have a common token at these places."""
    a, b = F.col(n1), F.col(n2)
    most = F.least(F.col(p1), F.col(p2)) + F.least(a - F.col(p1), b - F.col(p2))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * threshold) & (most * (100 + threshold) >= (a + b) * threshold)


def _largest(placed: DataFrame) -> DataFrame:
    """token, main: the largest component of each token that has more than one."""
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("m")).where("comps > 1").select("token", F.col("m.comp").alias("main"))


def _merged(members: DataFrame, links: DataFrame, first: bool) -> tuple[DataFrame, bool]:
    """Members (id, kin, comp) after more links, and whether there were any. first: every component is one member still."""
    if not first:
        lift = lambda c: members.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        links = links.join(lift("a"), "a").join(lift("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    more = components(links)
    if more is None:
        return members, False
    up = more.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return written(members.join(up, "comp", "left").select("id", "kin", F.coalesce("top", "comp").alias("comp")), "shingle-members"), True


def near_duplicates(docs: DataFrame, n_words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows, total = blocks.sized(docs)
    _catalogue(rows, n_words).write.parquet(path := scratch(spark, "shingle-catalogue"))
    catalogue = spark.read.parquet(path)
    listed = catalogue.where("name is not null").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(COMMON).toArrow()
    common = np.array(listed.column("name").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    documents = catalogue.where("name is null").select("block", "doc_id", "n", "id")
    groups = documents.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("first_id"), F.min("block").alias("block"), F.min("n").alias("n"))
    sent = spark.sparkContext.broadcast(common)  # at most COMMON names
    buckets = max(1, -(-(total // 20) // blocks.BUCKET_NAMES))  # a token asked for in some 20 bytes

    def held(part: pa.Table, told: pa.Table) -> list[tuple[bytes, np.ndarray]]:
        """The sets of the groups that this block speaks for."""
        ours = set(told.column("id").to_pylist()) - {None}
        sets = {}
        if ours:
            for s in shingle_sets(*text_buffer(part.column("text")), n_words):
                if len(s) and (i := set_id(s)) in ours:
                    sets.setdefault(i, s)
        return sorted(sets.items())

    def ask(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return blocks.messages([])
        order = Order(sent.value)
        prefixes = [order.prefix(s, threshold) for _, s in held(part, told)]
        if not prefixes:
            return blocks.messages([])
        return blocks.messages(question(part.column("block")[0].as_py(), np.unique(np.concatenate(prefixes)), buckets))

    def survivors(part: pa.Table, told: pa.Table) -> pa.Table:
        order, ids, kin, sizes, central_, sets, tokens, places = Order(sent.value), [], [], [], [], [], [], []
        own = held(part, told) if part.num_rows else []
        prefixes = [order.prefix(s, threshold) for _, s in own]
        if prefixes:
            distinct, place, count = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
            shared = ((count > 1) | read_answer(told.filter(pc.is_valid(told.column("bucket"))), distinct, buckets))[place]
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            for (i, s), p, a, b in zip(own, prefixes, at[:-1], at[1:], strict=True):
                live = np.flatnonzero(shared[a:b])
                central = len(live) / (b - a)
                if len(live) >= sure(len(s)) and (live := live[live < prefix_size(len(s), threshold)]).size:
                    p = p[: prefix_size(len(s), threshold)]
                    ids.append(i)
                    kin.append(set_id(np.append(p, np.uint64(len(s)))))
                    sizes.append(len(s))
                    central_.append(central)
                    sets.append(s.tobytes())
                    tokens.append(p[live].view(np.int64))
                    places.append(live)
        return pa.table([pa.array(ids, pa.binary()), pa.array(kin, pa.binary()), pa.array(sizes, pa.int64()), pa.array(central_, pa.float64()), pa.array(sets, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], ["id", "kin", "n", "central", "set", "tokens", "places"])

    speakers = groups.select("block", "id")
    told = blocks.answers(meet(rows, speakers, ask, blocks.MESSAGE))
    both = told.withColumn("id", F.lit(None).cast("binary")).unionByName(speakers.select("block", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("payload"), "id"))
    meet(rows, both, survivors, "id binary, kin binary, n long, central double, set binary, tokens array<long>, places array<long>").write.option("compression", "zstd").parquet(path := scratch(spark, "shingle-sets"))
    sets = spark.read.parquet(path)

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold)))
    members = written(sets.select("id", "kin", F.col("id").alias("comp")), "shingle-members")
    heads = members.groupBy("kin").agg(F.min("id").alias("head"))
    own = sets.select("id", "n", band.alias("band"), "central", "kin", "tokens", "places").join(heads.select(F.col("head").alias("id")), "id", "left_semi")
    exploded = own.select("id", "n", "band", "central", "kin", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    tokens = written(exploded.select(F.col("t.tokens").alias("token"), F.col("t.places").alias("place"), "id", "n", "band", "central", "kin"), "shingle-tokens")
    tried = None
    for nth in range(LEADERS):
        # Heads stand for their groups at first, then each group for each of its components once.
        rows_ = tokens.drop("id").join(members.groupBy("kin", "comp").agg(F.min("id").alias("id")), "kin") if nth else tokens.withColumn("comp", F.col("id"))
        able = rows_.join(_largest(rows_), "token").where("comp <> main") if nth else rows_
        leader = able.groupBy("token", "band").agg(F.max_by(F.struct("id", "n", "place", "comp"), F.struct("central", "id")).alias("l")).select("token", "band", F.col("l.id").alias("l_id"), F.col("l.n").alias("l_n"), F.col("l.place").alias("l_place"), F.col("l.comp").alias("l_comp"))
        star = rows_.join(leader, ["token", "band"]).where((F.col("comp") != F.col("l_comp")) & _may_link("n", "place", "l_n", "l_place", threshold)).select(F.least("l_id", "id").alias("a"), F.greatest("l_id", "id").alias("b"))
        if nth:
            star = star.distinct().join(tried, ["a", "b"], "left_anti")
        else:
            star = star.unionByName(members.join(heads, "kin").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))).distinct()
        star = written(star, "shingle-pairs")
        tried = star if tried is None else tried.unionByName(star)
        members, changed = _merged(members, _linked(star, sets, threshold), not nth)
        if not changed:
            break
    placed = tokens.drop("id").join(members.groupBy("kin", "comp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")), "kin")
    mixed = placed.join(_largest(placed), "token")
    # Sets of sizes near enough for a link are in one band or in neighbours, so they meet in one of two keys.
    keyed = mixed.withColumn("key", F.col("band")).unionByName(mixed.withColumn("key", F.col("band") + 1))
    ends = F.struct("id", "n", "place")
    met = keyed.groupBy("token", "key").agg(F.sum("m").alias("m"), F.min("comp").alias("c"), F.max("comp").alias("o_c"), F.min(ends).alias("x"), F.max(ends).alias("y"), F.max_by("id", F.struct("central", "id")).alias("leader")).where("c <> o_c")
    two = met.where("m = 2").select("x.id", "x.n", "x.place", F.col("y.id").alias("o_id"), F.col("y.n").alias("o_n"), F.col("y.place").alias("o_place"))
    two = two.where(_may_link("n", "place", "o_n", "o_place", threshold)).select(F.col("id").alias("a"), F.col("o_id").alias("b"))
    led = keyed.join(met.where("m > 2").select("token", "key", "leader"), ["token", "key"]).select("kin", "comp", "leader").distinct().join(members, ["kin", "comp"]).where("id <> leader").select("id", "leader")
    differences = written(_differences(led, sets, lambda: Order(sent.value), threshold), "shingle-differences")
    beside = differences.where("linked").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    near = _near(differences, members, threshold).unionByName(two).distinct().join(tried, ["a", "b"], "left_anti")
    members, _ = _merged(members, _linked(near, sets, threshold).unionByName(beside), False)
    final = groups.select("id", "first_id").join(members.select("id", "comp"), "id", "left").select("id", "first_id", F.coalesce("comp", "id").alias("comp"))
    label = final.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = final.join(label, "comp").select(F.col("id").alias("g_id"), "component_id")
    out = documents.join(named, (F.col("id") == F.col("g_id")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, n_words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all columns stay. Rows with a null doc_id stay."""
    (own,) = fresh(docs, "own_id")
    kept = near_duplicates(docs, n_words, threshold).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    joined = docs.join(kept, F.col("doc_id").cast("long") == F.col(own), "left")
    return joined.where(F.col(own).isNotNull() | F.col("doc_id").isNull()).drop(own)
