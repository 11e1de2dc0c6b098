"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists, exact verification.

1. One pass makes each document's set of distinct word windows, its size, a 128-bit key of the set and its
   bottom-k sketch. Documents with equal sets are one class, named by the least doc_id.
2. A retained value that one class alone holds can link nothing. Two sets as alike as asked for share at least
   ``common_values(size)`` retained values, so of a class's shared values, rarest first, only as many are
   listed as leave one value fewer than that (prefix filter over a corpus-wide order). Values that whole
   crowds share stay out of the lists this way.
3. Classes that are listed get their whole sets. One of whose values too few are in any other whole set can't
   link and goes.
4. Each inverted list first compares its members with one pivot, the member whose retained values are the most
   widely shared (the hub of a crowd of edited copies). Pairs go through the size filter, then the union-sketch
   estimate, then exact Jaccard similarity on whole sets; links make components.
5. Lists whose members are all in one component are done. In the rest, pairs of different components remain.
   Two members have in common at most the smaller of what they share with the pivot plus the smaller of what
   else of theirs is shared at all; pairs that this bound leaves too little are passed over, the others are
   compared, each in the first list that they share. Lists of more than LONG members are first split by a second
   value that such a pair must share, and go through 4 again; after DEPTH splits all are compared as they are.
   So no pair is given up.

Sketches of sets up to K values are whole sets. For larger ones ``common_values`` lies five standard
deviations below the expected overlap at the threshold: by the binomial tail a link of exactly 85 % is lost with
a chance of 8.8e-6, one of 80 % with 4.2e-6, and higher ones less. ``k=None`` lists whole sets and loses none.

Defined cases: null and empty texts, and texts of white space, have size 0 and link with nothing; fewer words
than a window make one window. Rows that share an id are told apart by their sets; such sets, and those of rows
without an id, take part under a number made of the set's key. A component is named by the least id of its rows,
null if none has one; ``kept`` marks every row of that id. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec
from .common import cut
from .components import merge

K, WORDS = 64, 5
#: Lists up to this length compare their remaining pairs; longer ones are split first.
LONG = 20_000
DEPTH = 3
#: The least union-sketch estimate at which a pair with a pivot gets its exact similarity.
PIVOT_LEAST = 0.4
#: Ids that may be broadcast (8 bytes each); beyond, a shuffled join takes its place.
BROADCAST_IDS = 2_000_000
#: Rows (an id and a digest) that may be broadcast.
BROADCAST_ROWS = 500_000


def common_values(percent: int, n: Column, k: int | None = K) -> Column:
    """Retained values that a set of n shares at least with the sketch of any set as alike as percent."""
    t = percent / 100
    all_ = F.ceil(n * percent / 100)
    if k is None:
        return all_.cast("int")
    far = math.ceil((t - 5 * math.sqrt(t * (1 - t) / k)) * k)
    return F.when(n <= int(t * k), all_).otherwise(far).cast("int")


def _sets(words: int, most: int | None, more: tuple[str, ...] = ()):
    """Arrow function: size, key and the ``most`` smallest values of each document's set, and ``more`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.steps(batches):
            h, at = textvec.windows(*textvec.word_hashes(texts), words)
            values, at = textvec.distinct((h >> textvec.U(1)).view("int64"), at)
            n = at[1:] - at[:-1]
            keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(at, at[1:], strict=False)]
            if most is None:
                kept, offsets = values, at
            else:
                kept = values[textvec.np.concatenate([textvec.np.arange(a, min(b, a + most)) for a, b in zip(at, at[1:], strict=False)])]
                offsets = textvec.np.concatenate([[0], textvec.np.cumsum(textvec.np.minimum(n, most))])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), common.lists(kept, offsets, pa.int64()), *map(rows.column, more)],
                names=["doc_id", "n", "key", "vals", *more],
            )

    return run


_SCHEMA = "doc_id long, n long, key binary, vals array<long>"


class _Search:
    """Finds and confirms links between classes (cls, rep, n, key, vals): cls names one, rep is its least id or null."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, k: int | None) -> None:
        self.docs, self.classes, self.words, self.percent, self.k = docs, classes, words, percent, k
        #: What pairs have in common, so far: (a, b, common).
        self.known = docs.sparkSession.createDataFrame([], "a long, b long, common int")
        self.labels = docs.sparkSession.createDataFrame([], "node long, label long")

    def prefixes(self) -> DataFrame:
        """(cls, n, hub, take, listed): each class's shared values, rarest first, one more than its lists need."""
        vals = self.classes.select("cls", "n", F.explode("vals").alias("v"))
        shared = vals.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
        rows = vals.join(shared, "v").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("l"))
        need = common_values(self.percent, F.col("n"), self.k)
        rows = rows.withColumn("take", F.size("l") - need + 1).filter("take > 0")
        hub = F.aggregate("l", F.lit(0).cast("long"), lambda z, x: z + x["df"])
        return rows.select("cls", "n", hub.alias("hub"), "take", F.transform(F.slice("l", 1, F.col("take") + 1), lambda x: x["v"]).alias("listed"))

    def fits(self, a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def confirm(self, pairs: DataFrame, least: float | None = None) -> None:
        """Find the similarity of pairs (a, b, a < b) and merge the components that links join.

        ``least`` is the estimate below which a pair of large sets is passed over; by default the one that no
        pair at the threshold falls below by chance.
        """
        pairs = cut(pairs.distinct().join(self.known, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        side = lambda s: self.classes.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("vals").alias(f"v{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        union = F.array_sort(F.array_union("va", "vb"))
        if self.k:
            union = F.when(F.greatest("na", "nb") <= self.k, union).otherwise(F.slice(union, 1, self.k))
        overlap = F.size(F.array_intersect(F.array_intersect("va", "vb"), union))
        t = self.percent / 100
        slack = 5 * math.sqrt(t * (1 - t) / self.k) if self.k else 0.0
        near = cut(both.filter(overlap / F.size(union) >= (t - slack - 1e-9 if least is None else least)).select("a", "b"))
        side = lambda s: self.sets.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("vals").alias(f"v{s}"))
        inter = F.size(F.array_intersect("va", "vb"))
        full = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", inter.alias("common"))
        full = cut(full.withColumn("link", 100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))))
        self.known = self.known.union(full.select("a", "b", "common"))
        self.labels = merge(self.labels, full.filter("link").select("a", "b"))

    def whole_sets(self, ids: DataFrame) -> DataFrame:
        """(cls, n, vals) of the classes (cls): their whole sets."""
        wanted = cut(self.classes.select("cls", "rep", "key").join(ids, "cls", "left_semi"))
        few = wanted.count() <= BROADCAST_IDS
        texts, reps = common.text_of(self.docs), wanted.select("rep")
        texts = texts.join(F.broadcast(reps) if few else reps, texts["doc_id"] == reps["rep"], "left_semi")
        if not wanted.filter("rep is null").isEmpty():
            texts = texts.unionByName(common.text_of(self.docs).filter("doc_id is null"))
        sets = texts.mapInArrow(common.lean(_sets(self.words, None)), _SCHEMA).dropDuplicates(["key"])
        return sets.select("key", "n", "vals").join(wanted.select("key", "cls"), "key").select("cls", "n", "vals")

    def against_pivots(self, lists: DataFrame) -> DataFrame:
        """Compare each list (v, cls, n, m, hub, pre) with its pivot. The rows of lists that then still span several
        components, with label, what the member shares with the pivot (i, null where unknown) and the list's size."""
        pivot = lists.groupBy("v").agg(F.max(F.struct("hub", (-F.col("cls")).alias("m"), "n")).alias("p"))
        rows = lists.join(pivot, "v").withColumns({"a": F.least("cls", -F.col("p.m")), "b": F.greatest("cls", -F.col("p.m"))})
        rows = cut(rows.withColumn("fits", self.fits("n", "p.n")).drop("p", "hub"))
        self.confirm(rows.filter("a < b and fits").select("a", "b"), PIVOT_LEAST)
        own = self.labels.select(F.col("node").alias("cls"), "label")
        rows = rows.join(own, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed = rows.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
        rows = rows.join(mixed.select("v", "size"), "v").join(self.known, ["a", "b"], "left")
        return cut(rows.select("v", "cls", "n", "m", "pre", "label", "size", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.col("common")).alias("i")))

    def open_pairs(self, rows: DataFrame, first: bool) -> DataFrame:
        """Pairs of one list that may be links between components; if ``first``, each in its first list only."""
        other = rows.select("v", *(F.col(c).alias(f"{c}_") for c in ("cls", "n", "m", "pre", "label", "i")))
        on = (F.col("cls") < F.col("cls_")) & (F.col("label") != F.col("label_")) & self.fits("n", "n_")
        most = F.least("i", "i_") + F.least(F.col("m") - F.col("i"), F.col("m_") - F.col("i_"))
        enough = (100 + self.percent) * most >= self.percent * (F.col("n") + F.col("n_"))
        on = on & F.coalesce(enough | F.col("i").isNull() | F.col("i_").isNull(), F.lit(True))
        if first:
            on = on & (F.element_at(F.array_intersect("pre", "pre_"), 1) == F.col("v"))
        return rows.join(other, "v").filter(on).select(F.col("cls").alias("a"), F.col("cls_").alias("b"))

    def split(self, rows: DataFrame, prefixes: DataFrame) -> DataFrame:
        """Lists by a second value that two members as alike as asked for share besides the first."""
        rows = rows.select("v", "cls").join(prefixes, "cls").select("v", "cls", "n", "m", "hub", F.col("listed").alias("pre"), F.explode("listed").alias("w"))
        return rows.filter("v <> w").select(F.xxhash64(F.least("v", "w"), F.greatest("v", "w")).alias("v"), "cls", "n", "m", "hub", "pre")

    def run(self) -> DataFrame:
        prefixes = cut(self.prefixes())
        self.sets = cut(self.whole_sets(prefixes.select("cls")))
        vals = self.sets.select("cls", F.explode("vals").alias("v"))
        shared = vals.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
        m = vals.join(shared, "v").groupBy("cls").agg(F.count("*").cast("int").alias("m"))
        prefixes = cut(prefixes.join(m, "cls").filter(100 * F.col("m") >= self.percent * F.col("n")))
        pre = F.slice("listed", 1, F.col("take"))
        lists = prefixes.select("cls", "n", "m", "hub", pre.alias("pre"), F.explode(pre).alias("v"))
        for depth in range(DEPTH + 1):
            rows = self.against_pivots(cut(lists))
            done = rows if depth == DEPTH else rows.filter(F.col("size") <= LONG)
            self.confirm(self.open_pairs(done, first=depth == 0))
            rest = rows.filter(F.col("size") > LONG)
            if depth == DEPTH or rest.isEmpty():
                return self.labels
            lists = self.split(rest, prefixes)


def _named(classes: DataFrame) -> DataFrame:
    """Classes with a name ``cls`` of their own: the least id, or, where that is null or names several sets, a number
    from the set's key, above usual ids."""
    odd = cut(classes.groupBy("rep").agg(F.count("*").alias("sets")).filter("rep is null or sets > 1").select(F.col("rep").alias("odd"), F.lit(True).alias("is_odd")))
    if odd.isEmpty():
        return classes.withColumn("cls", F.col("rep"))
    number = F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    marked = classes.join(odd, classes["rep"].eqNullSafe(odd["odd"]), "left")
    return cut(marked.withColumn("cls", F.when(F.col("is_odd"), number).otherwise(F.col("rep"))).drop("odd", "is_odd"))


def _grouped(docs: DataFrame, words: int, percent: int, k: int | None, *more: Column) -> DataFrame:
    """(doc_id, more, n, label, component_id) for each row; label is one for each component, null for empty sets."""
    common.prepare(docs.sparkSession)
    texts = common.text_of(docs, *more)
    extra = [f for f in texts.schema.fields if f.name not in ("doc_id", "text")]
    schema = ", ".join([_SCHEMA, *(f"{f.name} {f.dataType.simpleString()}" for f in extra)])
    base = cut(texts.mapInArrow(common.lean(_sets(words, k, tuple(f.name for f in extra))), schema))
    filled = base.filter("n > 0")
    classes = _named(cut(filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("vals").alias("vals"))))
    labels = _Search(docs, classes, words, percent, k).run()
    named = classes.select("key", "cls", "rep").join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select("key", "rep", F.coalesce("label", "cls").alias("label"))
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.select("key", "label").join(names, "label")
    return base.drop("vals").join(named, "key", "left").drop("key")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80, k: int | None = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: its set's size, the least id that links reach.

    ``k`` values are retained of each set; None keeps whole sets, so that no link at all can be lost.
    """
    rows = _grouped(docs, words, percent, k)
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with its columns: that of the least id, a null one last, then of the
    least hash of the text. Of rows with equal id and text one stays, whichever. Rows without words all stay."""
    digest = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = cut(_grouped(docs, words, percent, K, digest.alias("digest")).filter("label is not null").select("label", "doc_id", "digest"))
    rows = rows.groupBy("label", "doc_id", "digest").agg(F.count("*").alias("times"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("best")
    crowds = rows.groupBy("label").agg(best, F.sum("times").alias("size")).filter("size > 1").drop("size")
    rows = cut(rows.join(crowds, "label").select(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_"), "times", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("first")))
    here = lambda d, r: d["doc_id"].eqNullSafe(r["id_"]) & (F.xxhash64(F.coalesce(d["text"], F.lit(""))) == r["digest_"])
    gone, again = rows.filter("not first"), rows.filter("first and times > 1")
    few = lambda r: F.broadcast(r) if r.count() <= BROADCAST_ROWS else r
    rest = docs.join(few(gone), here(docs, gone), "left_anti")
    if again.isEmpty():
        return rest
    once = rest.join(few(again), here(rest, again), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(few(again), here(rest, again), "left_anti").unionByName(once)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), WORDS, 85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) i
  JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * i.c >= 85 * (na.n + nb.n - i.c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
