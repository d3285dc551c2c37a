"""N-gram Jaccard join over a token-group matrix.

1. Texts with equal words form classes; one member of each goes on.
2. Documents that share a MinHash value are likely similar and form buckets, in
   parts of bounded size; inside a part the links are verified exactly and joined up
   to components. A large component is a group of the matrix; small ones that share
   their commonest MinHash value are put together into groups of bounded size, so
   that a passage that many documents share makes few groups.
3. The matrix has a row (token, group) for the union of the members' tokens that a
   link needs: in a fixed order of all tokens, rare ones first, two sets that reach
   the similarity share one of their first n - ceil(t * n) + 1. A document's overlap
   with a group is thus bounded by the tokens they share in it; where none is shared,
   or no member has a fitting size, the group stays closed.
4. Members of the opened groups, and of the own group if it holds other components,
   are compared exactly, and all links are joined up.

The order ranks tokens by a count sketch of the corpus. Any order gives exact
results; the sketch makes tokens of common passages come last.

Texts that are null or have no words have an empty set and link with nothing. Rows
with a null id stay alone (their component is null). Rows that repeat an id count as
one document with the links of all. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blobs import pack, squeezed, unpack, whole
from folioscope.llm.common import cut, named, release, valid_text, written
from folioscope.llm.components import components
from folioscope.llm.words import BYTE, mix, word_hashes

#: Documents that a part of a group holds, about.
PART_DOCS = 96
#: Ids or tokens up to which a table of them is broadcast (some 24 bytes each); beyond, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
#: Counters of the count sketch, as a power of two (a byte each when it is sent to the tasks), and the pieces it is summed in.
SKETCH_BITS, SKETCH_PIECES = 24, 64
MINHASHES = 3

def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    n = min(width, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * BYTE[17 + k]
    total = mix(total + np.uint64(n))
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


class Sets:
    """Sets of tokens under an index, to be compared with one set at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens, owners = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def linked(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets whose Jaccard similarity with ``own`` is ``percent`` or more."""
        low, high = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        many = high - low
        first = np.cumsum(many) - many
        hits = self.owners[np.arange(many.sum()) - np.repeat(first - low, many)]
        common = np.bincount(hits, minlength=len(self.sizes))
        return np.flatnonzero((common > 0) & (100 * common >= percent * (len(own) + self.sizes - common)))


def _facts(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, same, keys) of each document, and pieces of the count sketch (piece, places, counts)."""
    names = ["id", "n", "same", "keys", "piece", "places", "counts"]

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for pdf in batches:
            rows = []
            for id_, text in zip(pdf["id"], pdf["text"]):
                tokens = shingles(word_hashes(text), width)
                np.add.at(sketch, (tokens & np.uint64(len(sketch) - 1)).view(np.int64), np.uint32(1))
                same = hashlib.sha256(b" ".join(text.encode().lower().split())).digest()
                keys = [int(mix(tokens ^ BYTE[40 + k]).min().view(np.int64)) for k in range(MINHASHES)] if len(tokens) else []
                rows.append((id_, len(tokens), same, keys, None, None, None))
            yield pd.DataFrame(rows, columns=names).astype({"id": "Int64", "piece": "Int32"})
        for piece, counts in enumerate(sketch.reshape(SKETCH_PIECES, -1)):
            places = np.flatnonzero(counts).astype(np.uint32)
            if len(places):
                yield pd.DataFrame([(None, 0, None, None, piece, pack(places), pack(counts[places]))], columns=names).astype({"id": "Int64"})
        sketch = counts = pdf = rows = None
        release()

    return docs.mapInPandas(run, "id long, n long, same binary, keys array<long>, piece int, places binary, counts binary")


def _sketch(pieces: DataFrame) -> list[bytes]:
    """Classes of the counters' sums, eight for each doubling: a byte for each of 2**SKETCH_BITS, whatever the corpus, in compressed pieces."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for piece, places, counts in zip(pdf["piece"], pdf["places"], pdf["counts"]):
                own = total.setdefault(piece, np.zeros((1 << SKETCH_BITS) // SKETCH_PIECES, np.int64))
                own[unpack(places, np.uint32)] += unpack(counts, np.uint32)
        for piece, counts in total.items():
            classes = np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8)
            yield pd.DataFrame({"piece": [piece], "counts": [squeezed(classes.tobytes())]})

    out = [squeezed(bytes((1 << SKETCH_BITS) // SKETCH_PIECES))] * SKETCH_PIECES
    for row in pieces.repartition(SKETCH_PIECES, "piece").mapInPandas(run, "piece int, counts binary").collect():
        out[row.piece] = bytes(row.counts)
    return out


def _runs(batches, by: list[str]) -> Iterator[tuple[tuple, list]]:
    """Rows of a sorted stream, by runs of equal keys."""
    held, key = [], None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            own = tuple(getattr(row, c) for c in by)
            if own != key and held:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _with_small(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST_IDS else right, on)


def _buckets(reps: DataFrame) -> DataFrame:
    """(id, slot, key, docs): the MinHash values that documents share with others, and how many have them."""
    keyed = reps.select(F.col("rep").alias("id"), F.posexplode("keys").alias("slot", "key"))
    sizes = keyed.groupBy("slot", "key").agg(F.count("*").alias("docs")).where("docs > 1")
    return cut(keyed.join(sizes, ["slot", "key"]))


def _links_in_buckets(docs: DataFrame, buckets: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links inside the parts of buckets: at most one fewer than a part's documents."""
    parts = buckets.select("id", F.xxhash64("slot", "key", F.pmod(F.xxhash64("id", "slot"), F.ceil(F.col("docs") / PART_DOCS))).alias("part"))
    parts = cut(parts.distinct())
    members = _with_small(docs, parts, "id", parts.count()).select("id", "text", "part")

    def run(batches):
        found = []
        for _, rows in _runs(batches, ["part"]):
            sets = [shingles(word_hashes(r.text), width) for r in rows]
            whole = Sets(sets)
            root = list(range(len(rows)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for i, own in enumerate(sets):
                for j in whole.linked(own, percent).tolist():
                    if (a := top(i)) != (b := top(j)):
                        root[a] = b
                        found.append((rows[i].id, rows[j].id))
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return members.repartition("part").sortWithinPartitions("part").mapInPandas(run, "a long, b long")


def _groups(reps: DataFrame, near: DataFrame, buckets: DataFrame) -> DataFrame:
    """(rep, n, comp, grp, docs, comps): each document's component and group, and the group's documents and components.

    A group's number is a hash; groups whose hashes agree are one group, which stays exact.
    """
    roles = reps.join(near.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("comp"))
    held = cut(roles.groupBy("comp").agg(F.count("*").alias("held")))
    common = buckets.groupBy(F.col("id").alias("comp")).agg(F.max(F.struct("docs", "slot", "key")).alias("most"))
    small = held.where(F.col("held") < PART_DOCS).join(common, "comp").select("comp", "held", "most.slot", "most.key")
    rooms = small.groupBy("slot", "key").agg(F.ceil(F.sum("held") / PART_DOCS).alias("rooms"))
    put = small.join(rooms, ["slot", "key"]).select("comp", F.xxhash64("slot", "key", F.pmod(F.xxhash64("comp"), "rooms")).alias("room"))
    comps = cut(held.join(put, "comp", "left").select("comp", "held", F.coalesce("room", F.xxhash64("comp")).alias("grp")))
    sizes = comps.groupBy("grp").agg(F.sum("held").alias("docs"), F.count("*").alias("comps"))
    return cut(roles.join(comps.join(sizes, "grp").drop("held"), "comp"))


def _open_groups(docs: DataFrame, roles: DataFrame, sketch: list[bytes], width: int, percent: int) -> DataFrame:
    """(id, n, other): documents and the groups that the matrix could not rule out for them."""
    order = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts = np.frombuffer(b"".join(whole(x, (1 << SKETCH_BITS) // SKETCH_PIECES) for x in order.value), np.uint8)
        for pdf in batches:
            tokens, ids = [np.empty(0, np.uint64)], []
            for id_, text in zip(pdf["id"], pdf["text"]):
                own = shingles(word_hashes(text), width)
                n = len(own)
                own = own[np.lexsort((own, counts[own & np.uint64(len(counts) - 1)]))[: n + (-percent * n // 100) + 1]]
                tokens.append(own)
                ids.append(np.full(len(own), id_))
            if ids:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "id": np.concatenate(ids)})
        counts = pdf = tokens = ids = None
        release()

    held = roles.select(F.col("rep").alias("id"))
    rows = _with_small(docs, held, "id", roles.count()).mapInPandas(run, "token long, id long")
    rows = written(rows)  # read twice
    # Most tokens are in one document alone and go at once; what is left learns its groups.
    several = cut(rows.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1").select("token"))
    shared = cut(_with_small(rows, several, "token", several.count()).join(roles.select(F.col("rep").alias("id"), "grp", "n", "docs"), "id"))
    spread = shared.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    shared = cut(shared.join(spread, "token"))
    matrix = shared.groupBy("token", F.col("grp").alias("other"), F.col("docs").alias("others")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # Of two groups the one with fewer documents asks the other.
    fits = (F.struct("docs", "grp") < F.struct("others", "other")) & (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    opened = shared.join(matrix, "token").where(fits).select("id", "n", "other").distinct()
    own = roles.where("comps > 1").select(F.col("rep").alias("id"), "n", F.col("grp").alias("other"))
    return cut(opened.union(own))


def _links_between_groups(docs: DataFrame, roles: DataFrame, opened: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links of documents with opened groups: one for each component that a part of a group holds, for its members are connected already."""
    share = lambda what, n: F.pmod(F.xxhash64(what), F.ceil(F.col(n) / PART_DOCS)).cast("int")
    member = roles.select("grp", "comp", "n", F.col("rep").alias("id"), F.xxhash64("grp", share("rep", "docs")).alias("part"))
    parts = member.groupBy("grp", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    asks = opened.join(parts, F.col("other") == F.col("grp")).where(fits).select("part", "id").join(roles.select(F.col("rep").alias("id"), "comp"), "id")
    # The documents that ask one part are shared out too; its members go to each share.
    asked = asks.groupBy("part").agg(F.count("*").alias("asks"))
    rows = asks.join(asked, "part").select("part", share("id", "asks").alias("portion"), "id", "comp", F.lit(True).alias("asking"))
    copies = member.join(asked, "part").select("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("asks") / PART_DOCS).cast("int") - 1)).alias("portion"), "id", "comp", F.lit(False).alias("asking"))
    rows = cut(rows.union(copies))
    some = cut(rows.select("id").distinct())
    texts = _with_small(docs, some, "id", some.count())
    met = rows.join(texts, "id").repartition("part", "portion").sortWithinPartitions("part", "portion", "asking")

    def run(batches):
        key, members, sets, whole, found = None, [], [], None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.part, r.portion) != key:
                    key, members, sets, whole = (r.part, r.portion), [], [], None
                own = shingles(word_hashes(r.text), width)
                if not r.asking:
                    members.append((r.id, r.comp))
                    sets.append(own)
                    continue
                whole = whole or Sets(sets)
                others = {comp: id_ for id_, comp in (members[k] for k in whole.linked(own, percent))}
                found += [(r.id, id_) for comp, id_ in others.items() if comp != r.comp]
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.select("part", "portion", "asking", "id", "comp", "text").mapInPandas(run, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``: components of the documents whose shingle sets have a Jaccard similarity of ``percent`` or more."""
    docs = df.select(named(id_col).cast("long").alias("id"), valid_text(named(text_col)).alias("text"))
    facts = cut(_facts(docs, width))
    rows = facts.where("piece is null").select("id", "n", "same", "keys")
    reps = cut(rows.where("n > 0 and id is not null").groupBy("same").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    sketch = _sketch(facts.where("piece is not null").select("piece", "places", "counts"))

    buckets = _buckets(reps)
    near = components(_links_in_buckets(docs, buckets, width, percent))
    roles = _groups(reps, near, buckets)
    far = _links_between_groups(docs, roles, _open_groups(docs, roles, sketch, width, percent), width, percent)

    of_id = rows.where("n > 0 and id is not null").join(reps.select("same", "rep"), "same").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(far).union(of_id))
    out = rows.join(whole.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
