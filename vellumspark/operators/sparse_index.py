"""A kept index of postings for BM25, with block maxima and top-k by bounds.

Documents are dealt over small ranges by a hash of their id. A term's postings in
one range are one row, a block: ids, frequencies and lengths, and beside them those
(frequency, length) that no other posting of the block betters in both, of which
one has the block's greatest score whatever the collection's statistics are when
it is asked. Rows lie
in folders by a hash of the term, so a question reads only the folders of its own
terms and no text at all.

A question is answered in two passes. The postings of its few weightiest terms give
likely items, and their whole scores a threshold, the k-th best. Then terms whose
greatest scores together stay under the threshold can't bring an item in by
themselves; only the postings of the others are read, and of these only ranges
whose bounds reach the threshold. Items that still can reach it are scored whole.
No other item can score as much, so the answer is that of a full scan.

Documents can be added later. A batch is seen once it is listed, and a batch whose
writing broke off isn't listed. Defined results: a text that is null or has no word
has no postings but counts as a document; a question without a known word has no
hits; ids are expected once in the index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import contract_text as C
from . import folders, tables
from .retrieval import top_of

#: Documents in one range, about; folders of terms; postings that a question's first pass reads, about.
RANGE, FOLDERS, FIRST_POSTINGS = 64, 64, 2048
#: Number of the layout on disk; an index of another isn't taken for a kept one.
FORMAT = 2


@dataclass
class SparseIndex:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, items: DataFrame) -> SparseIndex:
        """An index of items (id, text) in a new folder; the number of ranges follows from the items."""
        ranges = max(1, -(-items.count() // RANGE))
        folders.write_json(spark, f"{path}/shape.json", {"ranges": ranges, "id": items.schema["id"].dataType.simpleString()})
        return cls(spark, path).add(items)

    @classmethod
    def kept(cls, items: DataFrame, name: str) -> SparseIndex:
        """The index of these files in the session's shared folder, made if there is none yet."""
        spark = items.sparkSession
        path = f"{tables.shared_dir(items)}/vellum-index-{name}-{folders.fingerprint(items, FORMAT, RANGE, FOLDERS)}"
        if not folders.exists(spark, f"{path}/shape.json"):
            fresh = f"{path}-{uuid.uuid4().hex}"
            cls.create(spark, fresh, items)
            if not folders.rename(spark, fresh, path):  # another session was first
                folders.delete(spark, fresh)
        return cls(spark, path)

    def add(self, items: DataFrame) -> SparseIndex:
        """Index more items (id, text) as one batch."""
        ranges = folders.read_json(self.spark, f"{self.path}/shape.json")["ranges"]
        batch = uuid.uuid4().hex
        words = items.select("id", C.words3(F.col("text")).alias("words"))
        counted = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        placed = counted.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
        posting = F.struct("id", "tf", "length")
        blocks = placed.groupBy("term", "range").agg(F.sort_array(F.collect_list(posting)).alias("postings"), F.count("*").cast("int").alias("held"))
        blocks = blocks.withColumn("best", _unbettered(F.col("postings")))
        dealt = blocks.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")).repartition("folder", F.pmod("range", F.lit(8)))
        dealt.sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").option("compression", "zstd").parquet(f"{self.path}/blocks/batch={batch}")
        size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size("words"), F.lit(0))), F.lit(0)).alias("total")).first()
        folders.write_json(self.spark, f"{self.path}/batches/{batch}.json", {"n": size["n"], "total": size["total"]})
        return self

    def _batches(self) -> dict[str, dict]:
        return {name.removesuffix(".json"): folders.read_json(self.spark, f"{self.path}/batches/{name}") for name in folders.names(self.spark, f"{self.path}/batches")}

    def blocks(self) -> DataFrame:
        """term, range, postings, most, least, folder of all listed batches."""
        kind = folders.read_json(self.spark, f"{self.path}/shape.json")["id"]
        schema = f"term string, range int, postings array<struct<id:{kind},tf:int,length:int>>, held int, best array<struct<length:int,tf:int>>, folder int"
        parts = [f"{self.path}/blocks/batch={b}" for b in self._batches()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/blocks").parquet(*parts)

    def search(self, questions: DataFrame, k: int = P.PREFETCH, k1: float = P.BM25_K1, b: float = P.BM25_B, digits: int = 6) -> DataFrame:
        """qid, id, score, rank of the k best items of each question (qid, question)."""
        return self.passes(questions, k, k1, b, digits)["hits"]

    def passes(self, questions: DataFrame, k: int = P.PREFETCH, k1: float = P.BM25_K1, b: float = P.BM25_B, digits: int = 6) -> dict[str, DataFrame]:
        """``hits`` of a search; ``asked``, all blocks of its terms (qid, term, range, bound); ``read``, those whose postings the second pass took first."""
        sizes, slack = self._batches().values(), 10.0**-digits  # scores are rounded, bounds aren't: half a unit of the last digit and some more
        n, total = sum(s["n"] for s in sizes), sum(s["total"] for s in sizes)
        ranges = folders.read_json(self.spark, f"{self.path}/shape.json")["ranges"]
        mean = F.lit(total / n if total else 1.0)
        saturation = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        asked = questions.select("qid", F.explode(F.array_distinct(C.words3(F.col("question")))).alias("term"))
        asked = tables.written(asked.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")))
        wanted = [r["folder"] for r in asked.select("folder").distinct().collect()]  # FOLDERS of them at most
        blocks = self.blocks().filter(F.col("folder").isin(wanted))
        heads = blocks.select("term", "range", "best", "held").join(asked.select("term").distinct(), "term", "left_semi")
        heads = heads.groupBy("term", "range").agg(F.flatten(F.collect_list("best")).alias("best"), F.sum("held").alias("held"))  # batches have blocks of their own
        heads = tables.written(heads.select("term", "range", F.array_max(F.transform("best", lambda p: saturation(p["tf"], p["length"]))).alias("top"), "held"))
        terms = heads.groupBy("term").agg(F.sum("held").alias("df"), F.max("top").alias("top"))
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = tables.written(terms.select("term", "df", idf.alias("idf"), (idf * F.col("top")).alias("bound")))
        own = tables.written(asked.select("qid", "term").join(terms, "term"))
        posted = blocks.select("term", "range", "postings").join(asked.select("term").distinct(), "term", "left_semi")  # what is shuffled from here on has asked terms only
        # What grows with the index is small as Parquet and many times that as a broadcast table, so joins of it are merged.

        def weights(needed: DataFrame, on: list[str]) -> DataFrame:
            """term, range, id, weight of the postings in the needed blocks."""
            read = posted.join(needed.select(on).distinct().hint("merge"), on, "left_semi").select("term", "range", F.explode("postings").alias("p")).join(terms.select("term", "idf"), "term")
            return read.select("term", "range", "p.id", (F.col("idf") * saturation(F.col("p.tf"), F.col("p.length"))).alias("weight"))

        def whole(items: DataFrame) -> DataFrame:
            """qid, id, score: all terms of the items' questions."""
            placed = items.select("qid", "id").withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
            each = tables.written(placed.join(own.select("qid", "term"), "qid"))
            found = each.join(weights(each, ["term", "range"]).hint("merge"), ["term", "range", "id"])
            return found.groupBy("qid", "id").agg(F.round(F.sum("weight"), digits).alias("score"))

        heaviest = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
        seeds = own.withColumn("before", F.coalesce(F.sum("df").over(heaviest), F.lit(0))).filter(F.col("before") < FIRST_POSTINGS).select("qid", "term")
        likely = top_of(seeds.join(weights(seeds, ["term"]), "term").groupBy("qid", "id").agg(F.sum("weight").alias("score")), 2 * k)
        least = top_of(whole(likely), k).filter(F.col("rank") == k).select("qid", (F.col("score") - slack).alias("least"))
        lightest = Window.partitionBy("qid").orderBy("bound", F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0)
        parted = tables.written(own.join(least, "qid", "left").withColumn("light", F.coalesce(F.sum("bound").over(lightest) < F.col("least"), F.lit(False))))
        bounds = tables.written(parted.join(heads, "term").select("qid", "term", "range", "light", "least", (F.col("idf") * heads["top"]).alias("bound")))
        spread = bounds.groupBy("qid", "range").agg(F.sum("bound").alias("all"), F.sum(F.when(F.col("light"), F.col("bound")).otherwise(0.0)).alias("rest"), F.first("least").alias("least"))
        open_ranges = tables.written(spread.filter(F.col("least").isNull() | (F.col("all") >= F.col("least"))).select("qid", "range", "rest", "least"))
        read = tables.written(bounds.filter(~F.col("light")).join(open_ranges.hint("merge"), ["qid", "range"], "left_semi").select("qid", "term", "range"))
        partial = read.join(weights(read, ["term", "range"]).hint("merge"), ["term", "range"]).groupBy("qid", "range", "id").agg(F.sum("weight").alias("partial"))
        reaching = partial.join(open_ranges.hint("merge"), ["qid", "range"]).filter(F.col("least").isNull() | (F.col("partial") + F.col("rest") >= F.col("least")))
        return {"hits": top_of(whole(tables.written(reaching.select("qid", "id"))), k), "asked": bounds.select("qid", "term", "range", "bound"), "read": read}


def _unbettered(postings: Column) -> Column:
    """(length, tf) by rising length, each with a higher frequency than all shorter ones."""
    by_length = F.sort_array(F.transform(postings, lambda p: F.struct(p["length"].alias("length"), (-p["tf"]).alias("tf"))))
    none = F.array().cast("array<struct<length:int,tf:int>>")
    longer = lambda kept, p: F.when((F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["tf"] < -p["tf"]),
                                    F.array_append(kept, F.struct(p["length"].alias("length"), (-p["tf"]).alias("tf")))).otherwise(kept)
    return F.aggregate(by_length, none, longer)
