"""N-gram Jaccard join by a token-group matrix: components of documents whose shingle sets are similar.

1. Similar documents share a part. A set's tokens (hashed shingles) are cut by hash range into more parts than two
   linked sets of that size can differ in, so linked sets agree in a whole part (small sets: in a choice of parts). One
   row per part and set is shuffled; rows of equal parts meet and form a group. Texts that merely share a passage do
   not agree in a whole part, so groups hold few strangers.
2. Of every group some members are pivots, at first the one that meets most others. The matrix row of the group is the
   token union of its pivots. A member is a query: its overlap with the union bounds its overlap with every pivot, and
   only where the bound allows a link is the group opened, that is the query compared with each pivot, exactly.
3. Links join components. A pivot has met all members and leaves the group; groups within one component are done.
   Rounds go on until no group spans two components: then every pair of linked sets either was compared or lies in one
   component.

Members of a large group are dealt out in chunks, each with the pivots; a small group is one chunk, all its members are
pivots, and it is worked off in one round. A chunk passes on only links that join components. Token sets go straight from
the texts to the small groups; only members of large groups have theirs written, for the rounds to come.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import Tables, grouped, whole_text
from pulsegrid.llm.shingles import mixed, shingle_sets
from pulsegrid.session import materialize

# Links need PART * |union| <= WHOLE * |intersection|.
PART, WHOLE = 80, 100
SHINGLE = 5
# Sets up to so many tokens agree after deleting at most two tokens each, and are met through all such deletions.
TINY = 11
# Linked sets that differ in d tokens at most agree in CHOICES[d] - d of so many parts at least, and are met through
# all choices of that many. Sets that may differ in more tokens are met through single parts.
CHOICES = {1: 3, 2: 5, 3: 7, 4: 8, 5: 8, 6: 9, 7: 9, 8: 10, 9: 11, 10: 12, 11: 13, 12: 14}
# Pivots of a group in a round after the first, and members of a chunk.
MOST_PIVOTS = 128
CHUNK = 1024


def _class_bounds() -> list[int]:
    bounds = [1, 2]
    while bounds[-1] < 2**40:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * WHOLE // PART + 1))
    return bounds


# Least sizes of the size classes: what links to a set of one class is of the same class or a neighbour.
BOUNDS = _class_bounds()
_LAYOUTS: dict[int, tuple] = {}


def size_class(n: int) -> int:
    return bisect_right(BOUNDS, n) - 1


def most_differences(c: int) -> int:
    """How many tokens two linked sets differ in at most, the smaller being of class c."""
    largest = BOUNDS[c + 1] - 1
    return (largest + largest * WHOLE // PART) * (WHOLE - PART) // (WHOLE + PART)


def layout(c: int) -> tuple[int, int, np.ndarray | None, np.ndarray, np.ndarray]:
    """For class c: parts, how many of them agree, the choices of that many or None, part bounds, and a salt per part."""
    if c in _LAYOUTS:
        return _LAYOUTS[c]
    differ = most_differences(c)
    if differ in CHOICES:
        k = CHOICES[differ]
        picks = np.array(list(combinations(range(k), k - differ)))
    else:
        # A set has at least 3.2 * differ tokens, so few parts are empty, and hardly ever more than the surplus.
        empty = 1.2 * differ * math.exp(-2.6)
        k, picks = differ + 1 + math.ceil(empty + 5 * math.sqrt(empty)), None
    bounds = np.array([(i << 64) // k for i in range(1, k)], dtype=np.uint64)
    salt = mixed(np.arange(k, dtype=np.uint64) + np.uint64((c + 1) << 32))
    _LAYOUTS[c] = k, k - differ, picks, bounds, salt
    return _LAYOUTS[c]


def part_keys(tokens: np.ndarray, c: int) -> np.ndarray:
    """Keys of which linked sets, the smaller being of class c, share at least one. `tokens` are sorted."""
    k, agree, picks, bounds, salt = layout(c)
    cut = np.concatenate([[0], np.searchsorted(tokens, bounds), [len(tokens)]])
    sums = np.append(np.uint64(0), np.cumsum(mixed(tokens), dtype=np.uint64))[cut]
    parts = mixed(np.diff(sums) + salt)
    if picks is not None:
        return mixed(parts[picks].sum(axis=1, dtype=np.uint64))
    filled = np.diff(cut) > 0
    # If fewer parts are empty than agree, a filled part agrees.
    return parts[filled] if k - filled.sum() < agree else parts


def keys_of(tokens: np.ndarray) -> np.ndarray:
    """All keys of a set; any two different linked sets share one."""
    n, out = len(tokens), []
    if not n:
        return tokens
    if n <= TINY:
        values = mixed(tokens)
        total = values.sum(keepdims=True)
        # Linked sets minus at most a fifth of their tokens each are equal.
        out += [mixed(total - values[list(x)].sum(keepdims=True) + np.uint64(n - d))
                for d in range(n // 5 + 1) for x in combinations(range(n), d)]
    if n > 9:
        c = size_class(n)
        out += [part_keys(tokens, c), part_keys(tokens, c - 1)]
    return np.unique(np.concatenate(out))


def _sets(docs: DataFrame, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(whole_text(text_col), "utf-8").alias("text"))

    def work(batches):
        seen = set()
        for batch in batches:
            at = 0
            for texts in grouped(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield make(ids, shingle_sets(texts, SHINGLE), seen)

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def class_id(tokens: np.ndarray) -> int:
    return int(mixed(mixed(tokens).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def _classes(ids, sets, _):
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) for s in sets], pa.int64())],
        names=["doc_id", "n_shingles", "class"])


def _keys(ids, sets, seen):
    """Keys of every set that this task has not seen yet: copies meet here before the shuffle."""
    out, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for tokens in sets:
        if len(tokens) and (c := class_id(tokens)) not in seen:
            seen.add(c)
            out.append(keys_of(tokens).view(np.int64))
            of.append(np.full(len(out[-1]), c))
    keys = np.concatenate(out)
    none = pa.nulls(len(keys), ids.type)
    return pa.RecordBatch.from_arrays([none, pa.array(keys), pa.array(np.concatenate(of))], names=["doc_id", "key", "class"])


def _tokens(ids, sets, _):
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
        names=["doc_id", "class", "tokens"])


def sent_tokens(texts: DataFrame) -> DataFrame:
    """Token sets where they are wanted, given (text, places): group, chunk, pivot, whole, component, tokens.

    A row whose set is not of a place's class is another row with the same id, and is not sent there.
    """

    def work(batches):
        for batch in batches:
            at = 0
            for group in grouped(batch.column(0).to_pylist()):
                places = batch.column(1).slice(at, len(group)).to_pylist()
                at += len(group)
                out = []
                for tokens, wanted in zip(shingle_sets(group, SHINGLE), places):
                    c, raw = class_id(tokens) if len(tokens) else None, tokens.tobytes()
                    out += [(p["group"], p["chunk"], p["component"], raw) for p in wanted if p["class"] == c]
                made = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["group", "chunk", "component", "tokens"])

    sent = texts.mapInArrow(work, "group long, chunk long, component long, tokens binary")
    return sent.withColumns({"pivot": F.lit(False), "whole": F.lit(True)})


def linked(both, n, m):
    return WHOLE * both >= PART * (n + m - both)


class GroupMatrix:
    """Tokens of a group's pivots: their union, and which pivot holds which token of it."""

    def __init__(self, pivots: list[np.ndarray]):
        self.union = np.unique(np.concatenate(pivots))
        self.holds = np.zeros((len(self.union), len(pivots)), dtype=np.uint8)
        for k, tokens in enumerate(pivots):
            self.holds[np.searchsorted(self.union, tokens), k] = 1
        self.sizes = np.array([len(p) for p in pivots])

    def linked(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the pivots that are linked to the query."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if WHOLE * len(at) < PART * len(query):
            return at[:0]  # even with the whole union the query shares too little: the group stays closed
        both = self.holds[at].sum(axis=0, dtype=np.int64)
        return np.flatnonzero(linked(both, len(query), self.sizes))


class Roots(dict):
    """Components that a task has joined."""

    def find(self, c):
        while self.get(c, c) != c:
            c = self[c]
        return c

    def join(self, x, y):
        """The two components if they were apart, else nothing."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return []
        self[max(x, y)] = min(x, y)
        return [(min(x, y), max(x, y))]


def links_within(members: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join the components of a group's members (component, tokens)."""
    while True:
        # What a member shares with the union of all others bounds what it shares with any of them.
        tokens, count = np.unique(np.concatenate([t for _, t in members]), return_counts=True) if members else (None, None)
        left = [m for m in members if WHOLE * (count[np.searchsorted(tokens, m[1])] > 1).sum() >= PART * len(m[1])]
        if len(left) == len(members):
            break
        members = left
    roots, found = Roots(), []
    for a in range(0, len(members), MOST_PIVOTS):
        pivots = members[a:a + MOST_PIVOTS]
        matrix = GroupMatrix([t for _, t in pivots])
        for k in range(a, len(members)):
            component, tokens = members[k]
            for j in matrix.linked(tokens).tolist():
                found += roots.join(component, pivots[j][0])
    return found


def open_groups(rows: DataFrame) -> DataFrame:
    """Links between components. `rows` hold group, chunk, pivot, whole, component, tokens; a chunk's pivots come first.

    A group that is whole in its chunk is worked off. Otherwise the chunk's queries meet the pivots. Only links that join
    what the chunk has not joined yet are passed on.
    """

    def work(batches):
        current, pivots, members, matrix, roots = None, [], [], None, Roots()
        for batch in batches:
            found = []
            for group, chunk, is_pivot, whole, component, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, chunk) != current:
                    found += links_within(members)
                    current, pivots, members, matrix, roots = (group, chunk), [], [], None, Roots()
                tokens = np.frombuffer(raw, np.uint64)
                if whole:
                    members.append((component, tokens))
                elif is_pivot:
                    pivots.append((component, tokens))
                else:
                    matrix = matrix or GroupMatrix([t for _, t in pivots])
                    for k in matrix.linked(tokens).tolist():
                        found += roots.join(component, pivots[k][0])
            yield batch_of(found)
        yield batch_of(links_within(members))

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    columns = rows.select("group", "chunk", "pivot", "whole", "component", "tokens")
    return columns.mapInArrow(work, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b). Every node takes the least root among its own, its
    neighbours' and its root's, until none changes."""
    both = tables.write(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = nodes.select("node", F.col("node").alias("root"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        far = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        label = tables.write(label.join(near, label.node == near.a, "left").join(far, "root").select(
            "node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root"), "far").alias("root")), "labels")
        if label.where("was <> root").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")


def similar_classes(groups: DataFrame, texts: DataFrame, shown: DataFrame) -> DataFrame:
    """(class, component) of the classes in `groups` (group, class, lead); `shown` (class, want) names a document of each.

    `texts` are doc_id and text of all documents.
    """
    spark, old, tokens = groups.sparkSession, None, None
    label = groups.select("class").distinct().select("class", F.col("class").alias("component"))
    members, number = groups, 0
    while True:
        tables = Tables(spark, "jaccard")
        members = tables.write(members.select("group", "class", "lead").join(label, "class"), "members")
        label = tables.write(label, "component")
        if old:
            old.drop()
        old, number = tables, number + 1
        # Groups that span components, and the component of which each has most members.
        shares = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.max("lead").alias("led"))
        open_ = shares.groupBy("group").agg(
            F.count(F.lit(1)).alias("spans"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max("led").alias("led"),
            F.max_by("component", "n").alias("main")).where("spans > 1").drop("spans")
        open_ = tables.write(open_, "open")
        if open_.isEmpty():
            return label
        # Groups of one chunk are worked off at once. In others the lead is the first pivot; later pivots are some that
        # are not of the main component, picked by hash: once all those have met everyone, the group is done.
        others = F.greatest(F.ceil((F.col("n") - F.col("most")) / MOST_PIVOTS), F.lit(1))
        picked = (F.col("component") != F.col("main")) & (F.pmod(F.xxhash64("class", F.lit(number)), others) == 0)
        chunks = F.ceil(F.col("n") / CHUNK)
        pivot = F.when(chunks == 1, F.lit(False)).when(F.col("led"), F.col("lead")).otherwise(picked)
        asked = tables.write(members.join(open_, "group").select(
            "group", "class", "component", pivot.alias("pivot"), chunks.alias("chunks")), "asked")
        whole = (F.col("chunks") == 1).alias("whole")
        queries = asked.select("group", F.pmod(F.xxhash64("class"), "chunks").alias("chunk"), "class", "component", F.lit(False).alias("pivot"), whole)
        sent = asked.where("pivot").select(
            "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "class", "component", "pivot", whole)
        sent = sent.unionByName(queries.join(asked.where("pivot").select("group").distinct().withColumn("has", F.lit(True)), "group", "left").where(
            "whole OR has").drop("has"))
        found = []
        if number == 1:  # groups that fit a chunk now are met this once
            wanted = sent.where("whole").join(shown, "class").groupBy("want").agg(
                F.collect_list(F.struct("class", "group", "chunk", "component")).alias("places"))
            near = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.want)).select(
                F.encode(whole_text("text"), "utf-8").alias("text"), "places")
            found.append(sent_tokens(near))
            large = asked.where("chunks > 1").select("class").distinct()
            if not large.isEmpty():
                some = texts.join(shown.join(large, "class"), texts.doc_id.eqNullSafe(F.col("want")), "left_semi")
                some = _sets(some, "doc_id", "text", _tokens, "class long, tokens binary").join(large, "class", "left_semi")
                tokens = materialize(some.select("class", "tokens").dropDuplicates(["class"]), "tokens")
                found.append(sent.where("not whole").join(tokens, "class"))
        else:
            found.append(sent.join(tokens, "class"))
        links = None
        for rows in found:
            rows = rows.select("group", "chunk", "pivot", "whole", "component", "tokens")
            rows = rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", F.desc("pivot"))
            part = tables.write(open_groups(rows).distinct(), "links")
            links = part if links is None else links.union(part)
        if not links.isEmpty():
            root = components(label.select(F.col("component").alias("node")).distinct(), links, tables)
            label = label.join(root, label.component == root.node).select("class", F.col("root").alias("component"))
        # Pivots have met everyone in their groups.
        members = asked.where("chunks > 1 AND NOT pivot").select("group", "class", F.lit(False).alias("lead"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id is the smallest id reachable over links between sets of five-word shingles of Jaccard similarity 0.8 or
    more. A document without words has an empty set and is alone; so is every row of it. Equal sets are one class from
    the start. Null texts are empty; a null id stays null and never names a component that has another id; repeated
    rows each get a row; an empty table gives an empty result. Columns other than id and text are not read.
    """
    base = materialize(_sets(docs, id_col, text_col, _classes, "n_shingles long, class long"), "shingle-classes")
    filled = base.where("n_shingles > 0")
    keys = _sets(docs, id_col, text_col, _keys, "key long, class long").select("key", "class")
    same = Window.partitionBy("key")
    span = keys.withColumns({"low": F.min("class").over(same), "high": F.max("class").over(same)})
    shared = span.where("low <> high").select("key", "class").distinct()
    # Keys with the same members make one group.
    print_of = [F.bit_xor(F.xxhash64("class", F.lit(k))).over(same) for k in (1, 2)]
    equal = shared.withColumn("equal", F.xxhash64(*print_of, F.count(F.lit(1)).over(same)))
    equal = materialize(equal.select("equal", "class").distinct(), "equal-parts")
    # All that meet the same lead, the member that most others meet, are one group.
    often = equal.groupBy("class").agg((F.count(F.lit(1)) * 2**20 + F.pmod(F.xxhash64("class"), F.lit(2**20))).alias("weight"))
    leads = equal.join(often, "class").groupBy("equal").agg(F.max_by("class", "weight").alias("group"))
    groups = equal.join(leads, "equal").select("group", "class").distinct()
    groups = materialize(groups.withColumn("lead", F.col("group") == F.col("class")), "groups")
    shown = groups.select("class").distinct().join(filled, "class").groupBy("class").agg(F.min("doc_id").alias("want"))
    shown = materialize(shown, "shown")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    label = similar_classes(groups, texts, shown)
    joined = filled.select("doc_id", "class").join(label, "class", "left").select(
        "doc_id", "class", F.coalesce("component", "class").alias("component"))
    first = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.select("class", "component").distinct().join(first, "component").select("class", "component_id")
    alone = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.join(named, "class").select("doc_id", "n_shingles", "component_id").union(alone)



def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id names their component, with all columns."""
    kept = similar_documents(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept_id")), "left_semi")


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
