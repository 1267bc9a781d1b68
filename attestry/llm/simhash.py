"""SimHash near-dedup by multi-index hashing.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's
word shingles. Fingerprints at `distance` differing bits or fewer are linked.
The fingerprint is cut into segments; by the pigeonhole principle two linked
fingerprints differ in at most r_i bits in some segment i as long as the sum of
(r_i + 1) exceeds the distance. So each fingerprint looks up the small Hamming
ball of radius r_i around each of its segments in a table of segment values, and
every match's complete distance is verified inside the join. Segments are about
as wide as the logarithm of the number of fingerprints, so that a table entry
holds few of them at any size; every layout finds every link.

Equal fingerprints are one vertex, so copies cost nothing; components come from
minimum labels over links and nothing is collected.

Defined results: null, empty and white-space texts have fingerprint zero and are
linked like any other; fewer words than a shingle are one shingle; texts of any
length count whole; repeated rows share a component, as do rows that share an id and a
fingerprint; a null id is nobody's smallest; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import ROW_KEY, Scratch, arrow_rows, checkpointed, keyed, one_row_a_key, read_table
from attestry.llm.graph import components


#: Bands and least values in a band: a pair at similarity 0.8 shares one with a chance of 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Rounds against centres before the pass over what they leave; a matter of cost, not of result.
STAR_ROUNDS = 4
#: Words of 64 parity bits in a text's sketch.
SKETCH_WORDS = 16
#: Members of a bucket that one task of the last pass holds against its other texts.
BLOCK = 4096
#: Most rows that are broadcast.
BROADCAST_ROWS = 1_000_000

_MULTIPLIERS = np.random.default_rng(20240611).integers(0, 1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> bytes:
    """XXH64 of every shingle, eight bytes each; fewer words are one shingle, none have none."""
    import xxhash

    digest = xxhash.xxh64_digest
    split = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    joined = b" ".join(split)
    if len(split) <= words:
        return digest(joined, seed) if split else b""
    ends = list(itertools.accumulate(len(w) + 1 for w in split))
    starts = itertools.chain((0,), ends)
    return b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)])


def majority(hashes: bytes) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes) // 8
    # rows of bits are summed in blocks, so that a very long text stays small
    raw, ones = np.frombuffer(hashes, dtype=np.uint8), np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 8 << 14):
        ones += np.unpackbits(raw[at : at + (8 << 14)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def layout(n: int, distance: int) -> list[tuple[int, int, int]]:
    """Segments (shift, width, radius) for n fingerprints; the radii cover every pair within `distance`."""
    number = max(2, min(3, distance + 1, 63 // max(1, (max(2, n) - 1).bit_length())))
    radii = [0] * number
    short = distance + 1 - number  # the sum of (r + 1) has to reach distance + 1
    for i in range(max(0, short)):
        radii[i % number] += 1
    out, shift = [], 0
    for i, radius in enumerate(radii):
        width = 64 // number + (i < 64 % number)
        out.append((shift, width, radius))
        shift += width
    return out


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (fp) that differ in `distance` bits or fewer."""
    segments = layout(fps.count(), distance)

    def value(shift: int, width: int):
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), value(s, w).alias("value")) for i, (s, w, _) in enumerate(segments)])).alias("e")
    table = fps.select(F.col("fp").alias("fp_b"), entry).select("fp_b", F.col("e.segment").alias("segment"), F.col("e.value").alias("value"))

    def around(i: int, shift: int, width: int, radius: int):
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("segment"), value(shift, width).bitwiseXOR(m).alias("value")))

    balls = F.flatten(F.array(*[around(i, *segment) for i, segment in enumerate(segments)]))
    probes = fps.select("fp", F.explode(balls).alias("p")).select("fp", F.col("p.segment").alias("segment"), F.col("p.value").alias("value"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= distance) & (F.col("fp") < F.col("fp_b"))
    return probes.join(table, ["segment", "value"]).filter(near).select(F.col("fp").alias("a"), F.col("fp_b").alias("b"))


def _least_of(members: DataFrame, joined: DataFrame, member: str) -> DataFrame:
    """(member, component_id): the least id (column rep) of each component, single members by themselves."""
    named = members.join(joined, members[member] == joined["vertex"], "left").select(member, "rep", F.coalesce("component", member).alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.select(member, "component").join(least, "component").select(member, "component_id")


def near_groups(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = checkpointed(fingerprints(docs, words=words, seed=seed))
    reps = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = _least_of(reps, components(links(reps, distance)), "fp")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: a mix of the least values of `rows` permutations of the distinct shingles."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[None, at : at + 4096] * _MULTIPLIERS[: bands * rows, None]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    key = np.zeros(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def parities(distinct: np.ndarray, width: int = SKETCH_WORDS) -> np.ndarray:
    """The parity of the number of distinct shingles in each of 64 * `width` classes, as `width` words.

    Bits that differ between two sketches count no more than shingles that one text has and the other has not.
    """
    mixed = distinct * np.uint64(0x9E3779B97F4A7C15)
    odd = np.bincount(((mixed >> np.uint64(32)) % np.uint64(64 * width)).astype(np.int64), minlength=64 * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """False only for texts below the similarity: J(A, B) >= s means |A - B| + |B - A| <= (|A| + |B|) (1 - s) / (1 + s)."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    # a thousandth of a shingle for rounding, which is on the side of more candidates
    return differ <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * ((1 - similarity) / (1 + similarity)) + 0.001


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, component_id): components of texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

    Candidates are the links of the fingerprints and, since a fingerprint of 64 bits
    moves by some 10 bits at a similarity of 0.8, texts that share a band of least
    shingle values. Every candidate is verified on the whole texts, unless it joins what
    is joined already or the sketches of parities prove it to be below the similarity.
    First a bucket compares its members with one of them, another in every round and the
    same in all buckets that hold it, so that a group of near copies becomes one component
    at the cost of its members. Then one pass takes every candidate that is left: in each
    bucket the texts outside its largest component against all texts of other components,
    in blocks, the sketches compared in the join. No candidate is left out. Texts of equal
    words are one vertex.
    """
    arrow_rows(docs.sparkSession)
    tables = Scratch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column("text").to_pylist()
            hashes = [shingle_hashes(t, words, seed) for t in texts]
            bodies = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            fps = np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            sets = [np.unique(np.frombuffer(h, dtype="<u8")) for h in hashes]
            bands = [band_keys(x, BANDS, BAND_ROWS).view(np.int64) for x in sets]
            sketches = [parities(x).view(np.int64) for x in sets]
            columns = {"doc_id": batch.column("doc_id"), "body": pa.array(bodies, pa.binary()), "fp": pa.array(fps), "bands": pa.array(bands, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns | {"sketch": pa.array(sketches, pa.list_(pa.int64())), "size": pa.array([len(x) for x in sets], pa.int64())})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = tables.written(given.mapInArrow(run, "doc_id long, body binary, fp long, bands array<long>, sketch array<long>, size long"))
    # one vertex for texts of equal words, named by its least document
    nodes = tables.written(prints.groupBy("body").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("fp", "bands", "sketch", "size")]))
    by_print = tables.written(nodes.groupBy("fp").agg(F.min("rep").alias("rep")))
    keys = F.concat(F.array(F.struct(F.lit(-1).alias("band"), F.col("fp").alias("key"))), F.transform("bands", lambda k, i: F.struct(i.alias("band"), k.alias("key"))))
    entries = nodes.select("rep", F.explode(keys).alias("e")).select("rep", "e.band", "e.key")
    many = entries.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    buckets = tables.written(entries.join(many, ["band", "key"], "left_semi"))
    ends = tables.written(links(by_print.select("fp"), distance))
    side = lambda end: by_print.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
    by_links = ends.join(side("a"), "a").join(side("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    wanted = buckets.select("rep").unionByName(by_links.select(F.col("a").alias("rep"))).unionByName(by_links.select(F.col("b").alias("rep"))).distinct()
    wanted = tables.written(wanted)
    # broadcast only where the number of candidates is small
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = tables.written(given.join(some, given["doc_id"] == some["rep"]).select("rep", "text"))
    sketched = tables.written(nodes.join(some, "rep", "left_semi").select("rep", "sketch", "size"))

    def verified(pairs: DataFrame) -> DataFrame:
        first = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
        second = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: dict[str, frozenset] = {}

                def shingles(text: str) -> frozenset:
                    if text not in held:
                        if len(held) > 64:
                            held.clear()
                        raw = shingle_hashes(text, words, seed)
                        held[text] = frozenset(raw[i : i + 8] for i in range(0, len(raw), 8))
                    return held[text]

                keep = []
                for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                    one, two = shingles(x or ""), shingles(y or "")
                    both = len(one & two)
                    keep.append(both >= similarity * (len(one) + len(two) - both))
                yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

        return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")

    def member(labels: DataFrame, name: str) -> DataFrame:
        """(rep, name): a candidate's component, sketch and size."""
        of = sketched.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left")
        return of.select("rep", F.struct("rep", F.coalesce("component", "rep").alias("component"), "sketch", "size").alias(name))

    ordered = (F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    apart = (F.col("x.component") != F.col("y.component")) & _may_be_similar("x", "y", similarity)
    found = tried = tables.written(by_links.limit(0))
    labels = components(found)
    for number in range(STAR_ROUNDS):
        of = buckets.join(member(labels, "x"), "rep")
        centre = buckets.groupBy("band", "key").agg(F.min_by("rep", F.xxhash64("rep", F.lit(number))).alias("rep")).join(member(labels, "y"), "rep").drop("rep")
        pairs = of.join(centre, ["band", "key"]).filter(apart).select(F.col("x.rep").alias("rep"), *ordered).join(tried, ["a", "b"], "left_anti")
        # a text is compared with one centre of all its buckets' in a round
        pairs = tables.written(pairs.groupBy("rep").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("p")).select("p.a", "p.b").distinct())
        new = tables.written(verified(pairs))
        tried = tables.written(tried.unionByName(pairs))
        if not new.head(1):
            break
        found = tables.written(found.unionByName(new))
        labels = components(found)

    # what is left: texts outside the largest component of their bucket, against all of other components
    of = tables.written(buckets.join(member(labels, "x").select("rep", F.col("x.component").alias("component")), "rep"))
    parts = of.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("band", "key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    in_split = tables.written(of.join(split, ["band", "key"]).select("rep", "band", "key", (F.col("component") != F.col("largest")).alias("outside"), F.ceil(F.col("n") / BLOCK).alias("blocks")))
    held = in_split.join(member(labels, "y"), "rep").select("band", "key", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "y", F.col("outside").alias("y_outside"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    outside = in_split.filter("outside").join(member(labels, "x"), "rep").select("band", "key", block, "x")
    once = ~F.col("y_outside") | (F.col("x.rep") < F.col("y.rep"))
    rest = outside.join(held, ["band", "key", "block"]).filter(apart & once).select(*ordered)
    by_print_links = by_links.join(member(labels, "x").withColumnRenamed("rep", "a"), "a").join(member(labels, "y").withColumnRenamed("rep", "b"), "b").filter(apart).select(*ordered)
    rest = tables.written(rest.unionByName(by_print_links).distinct().join(tried, ["a", "b"], "left_anti"))
    new = tables.written(verified(rest))
    if new.head(1):
        labels = components(tables.written(found.unionByName(new)))
    named = nodes.select("body", "rep", F.col("rep").alias("vertex_rep"))
    least = _least_of(named.select("rep", "vertex_rep"), labels, "vertex_rep")
    of_body = named.join(least, "vertex_rep").select("body", "component_id")
    return tables.result(prints.select("doc_id", "body").join(of_body, "body").select("doc_id", "component_id"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all of `documents`."""
    return near_groups(read_table(spark, sf_dir, "documents"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of texts linked by shingles of five words at a similarity of 0.8 or more, the one of the smallest key stays.

    Defined results: null and empty texts are one group, as are texts of equal words;
    rows with null or shared identifiers are told apart by their texts, and of
    wholly equal rows one stays; very long texts count whole; an empty table stays
    empty; all columns, of whatever names, keep their values.
    """
    rows = keyed(docs)
    groups = similar_groups(rows.select(F.col(ROW_KEY).alias("doc_id"), "text"))
    kept = groups.filter("component_id = doc_id").select(F.col("doc_id").alias(ROW_KEY))
    return one_row_a_key(rows.join(kept, ROW_KEY, "left_semi"), docs.columns)
