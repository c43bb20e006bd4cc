"""Near copies of the pipeline: SimHash links first, an exact prefix filter for those it can't reach.

Documents are sets of five-word shingles; two of a Jaccard of ``least`` or more are linked, and of each
component one row stays. Rows of one set are one node.

SimHash (operator 8: segment counts, grids, exact distance) proposes nodes whose fingerprints differ in
few bits. Two sets at a Jaccard of 0.8 differ in far more, small ones in any number, so no bound on bits
holds them all. The rest is therefore found by a prefix filter, which loses none whatever the sizes and
however many documents there are: all shingles are put in one order, and two sets that share enough of
their shingles share one among the first ``n - ceil(least n) + 1`` of each. Any order is right; frequent
shingles come last in ours, so that a prefix holds what few other documents have. At a shared shingle
what is left of both sets from there on must still hold enough, or the pair needn't be looked at.

Shingles of the prefixes are sorted by ranges, not grouped: a shingle that a third of all documents have
is cut at range borders like any other. Each document is first compared to the first one of its shingle
(that with the shortest unshared beginning); what these links join is one component. Then components
meet by one row each, round by round, while that links many, and in the end all pairs of different
components that the filter leaves, in blocks of bounded size. Candidates whose parities (a bit for each
class of shingles) already differ in too many places are dropped, those of a block where they meet, so that
it doesn't tell them once for each shingle they share; every other one is verified by the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window

from laneflow.llm import arrays, components, shared, simhash
from laneflow.llm.shared import F

SHINGLE = 5
LEAST = 0.8
#: Bits of 64 up to which SimHash proposes a pair.
BITS = 4
#: Frequent shingles that come last in the order at most; the order decides the cost, not the result.
FREQUENT = 1 << 18
#: Shingles that are counted together, and how often one must occur in them to be frequent.
COUNTED, OFTEN = 1 << 20, 4
#: Rows of a shingle that meet in one task at the end; more are cut into blocks.
BLOCK = 2_048
#: Rows of one key that one task of a join reads, about.
SPLIT = 8_192
#: Pairs that a block compares at once, and bytes of text that are taken into shingles at once: what a
#: Python worker holds besides its batch stays at some tens of MB.
AT_ONCE = 1 << 15
PIECE_BYTES = 1 << 19
#: Bits that tell texts which are surely not asked for from the others before they are shuffled.
MARKS = 1 << 22
NO_ID = -(1 << 63)
NODE = "node long, n long, fp long, parity array<long>, wide array<long>"
#: Words of 64 bits of a set's parities, those of a large set's second ones, and what makes it large. Sets of
#: some 2,300 shingles may differ in half of the first words' bits and be alike, sets of 9,000 in half of the second.
WORDS, WIDE, LARGE = 16, 64, 1_800
POSTING = "token long, node long, n int, pos int"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: words as op8 has them; all of a shorter text's words are one."""
    starts, ends, before = arrays.words(data, offsets)
    upper = (data >= 65) & (data <= 90)
    codes = arrays.Runs(arrays.BYTE_CODES[data | (upper.astype(np.uint8) << 5)]).hashes(starts, ends)
    runs = arrays.Runs(codes)
    out = []
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        width = min(shingle, hi - lo)
        first = np.arange(lo, hi - width + 1) if width else np.zeros(0, np.int64)
        out.append(np.unique(runs.hashes(first, first + width)))
    return out


def node_of(hashes: np.ndarray) -> int:
    """One value for a set; no words: zero."""
    return int(arrays.mix(arrays.mix(hashes + arrays.MULTIPLIER).sum(keepdims=True))[0]) if len(hashes) else 0


def print_of(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def parity_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """For each of ``64 * words`` classes of shingles whether the set has an odd number of them.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sets_of(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    return [h for _, data, offsets in arrays.pieces(part, most_bytes=PIECE_BYTES) for h in shingle_sets(data, offsets, shingle)]


def prints(part: pa.RecordBatch, shingle: int) -> pa.RecordBatch:
    """The columns of ``part`` but its text, and each row's node, number of shingles and fingerprint."""
    sets = sets_of(part, shingle)
    kept = [name for name in part.schema.names if name != "text"]
    return pa.RecordBatch.from_arrays(
        [
            *map(part.column, kept),
            signed([node_of(h) for h in sets]),
            pa.array([len(h) for h in sets], pa.int64()),
            signed([print_of(h) for h in sets]),
            pa.array([parity_of(h, WORDS) for h in sets], pa.list_(pa.int64())),
            pa.array([parity_of(h, WIDE) if len(h) >= LARGE else [] for h in sets], pa.list_(pa.int64())),
        ],
        [*kept, "node", "n", "fp", "parity", "wide"],
    )


def frequent(texts: DataFrame, shingle: int, most: int) -> np.ndarray:
    """Hashes of the most frequent shingles in ascending order of hash, and their ranks (0: the rarest of them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            times = np.diff(np.r_[starts, len(values)])
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays(
                [pa.array(values[starts[often]].view(np.int64)), pa.array(times[often])], ["token", "times"]
            )

        for batch in batches:
            for part in shared.parts(batch):
                held += {node_of(h): h for h in sets_of(part, shingle)}.values()
                if sum(map(len, held)) >= COUNTED:
                    yield told()
        if held:
            yield told()

    found = texts.mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    # ``most`` rows of one number at most, as numbers and not as row objects.
    rows = found.orderBy(F.desc("times"), "token").limit(most).select("token").toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return np.stack([tokens[order], (len(tokens) - order).astype(np.uint64)])


def prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def postings(part: pa.RecordBatch, shingle: int, least: float, last: np.ndarray) -> pa.RecordBatch:
    """``token, node, n, pos`` of the first shingles of each distinct set of a batch; the empty set has none."""
    sets = {node_of(h): h for h in sets_of(part, shingle) if len(h)}
    n = np.array([len(h) for h in sets.values()], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
    row = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(tokens), np.uint64)
    if last.shape[1]:
        at = np.minimum(np.searchsorted(last[0], tokens), last.shape[1] - 1)
        rank = np.where(last[0][at] == tokens, last[1][at], 0)
    order = np.lexsort((tokens, rank, row))
    pos = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    kept = pos < prefix_length(n, least)[row]
    nodes = np.array(list(sets), np.uint64).view(np.int64)
    columns = [tokens[order][kept].view(np.int64), nodes[row[kept]], n[row[kept]].astype(np.int32), pos[kept].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "pos"])


def by_range(rows: DataFrame) -> DataFrame:
    """Sorted by token, then place of the token in the set; a token of many rows is cut where a range ends."""
    return rows.repartitionByRange("token", "pos", "node").sortWithinPartitions("token", "pos", "node")


def met(rows: DataFrame) -> DataFrame:
    """The rows whose token another node has as well, once each, and a few at the borders of batches."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node = (batch.column(c).to_numpy() for c in ("token", "node"))
            same = token[1:] == token[:-1]
            # One token at one place of one node: copies of a document in several batches.
            again = np.r_[False, same & (node[1:] == node[:-1])]
            good = (np.r_[True, same] | np.r_[same, True]) & ~again
            yield batch.filter(pa.array(good))

    return by_range(rows).mapInArrow(keep, rows.schema)


def enough(n1: np.ndarray, pos1: np.ndarray, n2: np.ndarray, pos2: np.ndarray, least: float) -> np.ndarray:
    """May two sets that meet at these places be alike? What is left of both must hold what they have to share."""
    share = least / (1 + least) * (n1 + n2) - 1e-9
    return np.minimum(n1 - pos1, n2 - pos2) >= share


def stars(rows: DataFrame, least: float, chain: bool) -> DataFrame:
    """``a, b``: each row of ``token, node, n, pos, root`` with the first of its token, and with the one before
    if ``chain``, where their roots differ."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the first row of the last token so far, and the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            if carried is not None:
                batch = pa.Table.from_batches([*carried, batch]).combine_chunks().to_batches()[0]
            token, node, n, pos, root = (batch.column(c).to_numpy() for c in ("token", "node", "n", "pos", "root"))
            new = np.r_[True, token[1:] != token[:-1]]
            at = np.arange(len(token))
            first = np.maximum.accumulate(np.where(new, at, 0))
            pairs = [(first, at)] + ([(np.maximum(at - 1, first), at)] if chain else [])
            found = []
            for a, b in pairs:
                good = (root[a] != root[b]) & enough(n[a], pos[a], n[b], pos[b], least)
                found.append(np.stack([node[a[good]], node[b[good]]]))
            x = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*x)), pa.array(np.maximum(*x))], ["a", "b"])
            carried = [batch.slice(first[-1], 1), batch.slice(len(token) - 1, 1)]

    return by_range(rows).mapInArrow(link, "a long, b long").distinct()


def every_pair(rows: DataFrame, nodes: DataFrame, count: int, least: float, block: int) -> DataFrame:
    """``a, b``: all pairs of different roots at one token that may be alike, by their parities too."""
    groups = count // block + 1
    hot = rows.groupBy("token").agg(F.count("*").alias("size")).filter(F.col("size") > block)
    hot = shared.materialize(hot, "copies-hot").withColumnRenamed("token", "at")
    # Every pair of blocks of a hot token is a group of its own; all other tokens share groups.
    cut = (
        rows.join(hot, F.col("token") == F.col("at"), "left")
        .withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / block).cast("long"))
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .withColumn("part", F.when(F.col("blocks") > 1, F.col("token")).otherwise(F.pmod("token", F.lit(groups))))
        .join(nodes.select("node", "parity", "wide"), "node")
        .select("part", "i", "j", "token", "node", "n", "pos", "root", "parity", "wide")
    )
    return cut.groupBy("part", "i", "j").applyInArrow(lambda table: candidates(table, least), "a long, b long").distinct()


def few_apart(x: np.ndarray, y: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """May sets of these parities, ``n`` shingles both together, be alike?"""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (1 - least) / (1 + least) * n + 1e-9


def candidates(table: pa.Table, least: float) -> pa.Table:
    """Pairs of one group; a token has a few blocks of rows at most here."""
    table = table.combine_chunks()
    token, node, n, pos, root = (table.column(c).to_numpy() for c in ("token", "node", "n", "pos", "root"))
    parity, wide = (
        table.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
        for c, words in (("parity", WORDS), ("wide", WIDE))
    )
    second = np.cumsum(n >= LARGE) - 1  # a large set's place in ``wide``
    order = np.lexsort((node, token))
    token, node, n, pos, root = token[order], node[order], n[order], pos[order], root[order]
    parity, second = parity[order], second[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    at = np.arange(len(token))
    # Rows of a token against all later ones of it, a bounded number of pairs at once.
    after = np.repeat(starts + sizes, sizes) - at - 1
    out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    lo, total = 0, np.cumsum(after)
    while lo < len(token):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        a, b = np.repeat(at[lo:hi], after[lo:hi]), arrays.ranges(at[lo:hi] + 1, after[lo:hi]) if after[lo:hi].any() else at[:0]
        good = (root[a] != root[b]) & enough(n[a], pos[a], n[b], pos[b], least)
        a, b = a[good], b[good]
        good = few_apart(parity[a], parity[b], n[a] + n[b], least)
        large = np.flatnonzero(good & (np.minimum(n[a], n[b]) >= LARGE))
        x, y = a[large], b[large]
        good[large] = few_apart(wide[second[x]], wide[second[y]], n[x] + n[y], least)
        out.append(np.stack([node[a[good]], node[b[good]]]))
        lo = hi
    pairs = np.unique(np.concatenate(out, axis=1), axis=1)
    return pa.table({"a": np.minimum(*pairs), "b": np.maximum(*pairs)})


def dealt_join(left: DataFrame, right: DataFrame, key: str, split: int = SPLIT) -> DataFrame:
    """Inner join by ``key``, of which ``right`` has one row each; keys of many rows go to several tasks."""
    hot = left.groupBy(key).agg(F.ceil(F.count("*") / split).cast("int").alias("_tasks")).filter("_tasks > 1")
    hot = shared.materialize(hot, "copies-hot")
    tasks = F.coalesce("_tasks", F.lit(1))
    many = left.join(hot, key, "left").withColumn("_task", F.pmod(F.xxhash64(*left.columns), tasks)).drop("_tasks")
    each = right.join(hot, key, "left").withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), (tasks - 1).cast("long")))).drop("_tasks")
    return many.join(each, [key, "_task"]).drop("_task")


def near_enough(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Without the pairs whose parities differ in more than two alike sets of their sizes may."""

    def side(end: str) -> DataFrame:
        return nodes.select(F.col("node").alias(end), F.struct("n", "parity", "wide").alias(f"_{end}"))

    both = dealt_join(dealt_join(pairs, side("a"), "a"), side("b"), "b")

    def apart(words: str) -> Column:
        bits = F.zip_with(f"_a.{words}", f"_b.{words}", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(bits, F.lit(0), lambda total, x: total + x)

    most = F.lit((1 - least) / (1 + least)) * (F.col("_a.n") + F.col("_b.n")) + 1e-9
    small = F.least("_a.n", "_b.n") < LARGE
    return both.filter((apart("parity") <= most) & (small | (apart("wide") <= most))).select("a", "b")


def asked_texts(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """``node, text`` of the rows of ``keyed`` that ``chosen`` names.

    Only texts of a marked bit meet ``chosen``: a small table of bits, whose size is bounded, goes to the
    texts, so that those of other rows aren't shuffled. Rows that share a bit with a chosen one pass as well
    and end at the join.
    """
    word, bit = F.shiftright(F.col("_row").bitwiseAND(F.lit(MARKS - 1)), 6), F.col("_row").bitwiseAND(F.lit(63)).cast("int")
    marked = chosen.select(F.col("row").alias("_row")).groupBy(word.alias("_word"))
    marked = marked.agg(F.bit_or(F.expr("shiftleft(1L, cast(_row & 63 as int))")).alias("_bits"))
    texts = keyed.select("_doc", "_row", "text").withColumn("_word", word).join(F.broadcast(marked), "_word")
    texts = texts.filter(F.getbit("_bits", bit) == 1).select("_doc", "_row", "text")
    return texts.join(chosen, (F.col("_doc") == F.col("doc_id")) & (F.col("_row") == F.col("row"))).select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs of which the sets share ``least`` of all their shingles, from the texts themselves."""
    pairs = shared.materialize(near_enough(pairs, nodes, least), "copies-near")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    chosen = nodes.select("node", "least.*").join(asked, F.col("node") == F.col("of"), "left_semi")
    chosen = shared.materialize(chosen, "copies-asked")
    texts = asked_texts(keyed, chosen)

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [h.view(np.int64) for h in sets_of(part, shingle)]
        return pa.RecordBatch.from_arrays(
            [part.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "set"]
        )

    known = shared.per_batch(texts, sets, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))
    known = shared.materialize(known, "copies-sets")
    one = dealt_join(pairs, known.select(F.col("node").alias("a"), F.col("set").alias("left")), "a")
    both = F.size(F.array_intersect("left", "right"))
    found = (
        dealt_join(one, known.select(F.col("node").alias("b"), F.col("set").alias("right")), "b")
        .filter(both >= F.lit(least) * (F.size("left") + F.size("right") - both))
        .select("a", "b")
    )
    found = shared.materialize(found, "copies-links")
    shared.discard(known)
    return found


def simhash_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """``a, b``: nodes of one fingerprint with their least, and such least nodes of near fingerprints."""
    held = shared.materialize(nodes.groupBy("fp").agg(F.min("node").alias("to")), "copies-prints")
    near = simhash.links(held.select("fp"), bits, simhash.BLOCK, simhash.groups_for(held.count(), bits))
    near = near.distinct().withColumnsRenamed({"a": "of", "b": "fp"})
    ends = near.join(held, "fp").select(F.col("to").alias("a"), F.col("of").alias("fp")).join(held, "fp").select("a", F.col("to").alias("b"))
    same = dealt_join(nodes.select("fp", "node"), held, "fp").filter("node <> to").select(F.col("to").alias("a"), F.col("node").alias("b"))
    return ends.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    roots = components.components(links).withColumnRenamed("node", "of").withColumnRenamed("root", "to")
    return rows.join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("to", "node")).drop("of", "to")


def still_open(rows: DataFrame) -> DataFrame:
    """Rows of the tokens that nodes of more than one root have."""
    several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    return rows.join(several.select("token"), "token", "left_semi")


def all_links(keyed: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, least: float, block: int) -> DataFrame:
    """``a, b``: links that join all nodes of a Jaccard of ``least`` or more."""
    last = frequent(texts, shingle, FREQUENT)
    first = shared.per_batch(texts, lambda part: postings(part, shingle, least, last), POSTING)
    first = shared.materialize(first, "copies-prefixes")
    rows = shared.materialize(met(first), "copies-met")
    shared.discard(first)
    seen = simhash_pairs(nodes, BITS).unionByName(stars(rows.withColumn("root", F.col("node")), least, False)).distinct()
    seen = shared.materialize(seen, "copies-pairs")
    links = verified(seen, nodes, keyed, shingle, least)
    while True:
        opened = shared.materialize(still_open(with_roots(rows, links)).drop("root"), "copies-open")
        shared.discard(rows)
        rows = opened
        parted = with_roots(rows, links)
        best = parted.groupBy("token", "root").agg(F.min(F.struct("pos", "node", "n")).alias("x"))
        pairs = stars(best.select("token", "x.*", "root"), least, True).join(seen, ["a", "b"], "left_anti")
        pairs = shared.materialize(pairs, "copies-pairs")
        tried = pairs.count()
        if not tried:
            break
        more = verified(pairs, nodes, keyed, shingle, least)
        seen, links = seen.unionByName(pairs), links.unionByName(more)
        # Few new links: what is open is hardly alike, and another round would not leave less for the end.
        if more.count() * 10 < tried:
            break
    parted = shared.materialize(still_open(with_roots(rows, links)), "copies-open")
    rest = every_pair(parted, nodes, parted.count(), least, block).join(seen, ["a", "b"], "left_anti")
    rest = shared.materialize(rest, "copies-pairs")
    if rest.isEmpty():
        return links
    return links.unionByName(verified(rest, nodes, keyed, shingle, least))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """The row of ``docs``, all columns, with the least ``doc_id`` of each component of near copies; of several
    such rows the one with the least hash of all columns, once. Null and empty texts are one node, whose only
    partner it is itself. A null id counts as the least. Columns of any name may stand beside ``doc_id`` and
    ``text``. An empty table stays empty."""
    keyed = docs.select(
        F.struct(*docs.columns).alias("_all"),
        F.xxhash64(*docs.columns).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.col("text").cast("string").alias("text"),
    )
    texts = keyed.select("text")
    rows = keyed.select(F.col("_doc").alias("doc_id"), F.col("_row").alias("row"), "text")
    rows = shared.per_batch(rows, lambda part: prints(part, shingle), f"doc_id long, row long, {NODE}")
    best = (F.min(F.struct("doc_id", "row")).alias("least"), F.first("parity").alias("parity"), F.first("wide").alias("wide"))
    nodes = shared.materialize(rows.groupBy("node", "n", "fp").agg(*best), "copies-nodes")
    links = all_links(keyed, texts, nodes, shingle, least, block)
    kept = (
        with_roots(nodes.select("node", "least"), links)
        .groupBy("root")
        .agg(F.min("least").alias("x"))
        .select(F.col("x.doc_id").alias("_doc"), F.col("x.row").alias("_row"))
    )
    same = Window.partitionBy("_doc", "_row").orderBy("_row")
    return keyed.join(kept, ["_doc", "_row"], "left_semi").withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").select("_all.*")
