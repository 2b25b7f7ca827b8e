"""N-gram language models: interpolated modified Kneser-Ney (Chen and Goodman, 1998) in DataFrames, as ARPA files.

Sentences are arrays of words with a weight, put between ``<s>`` and ``</s>``. One explosion counts the longest n-gram that
ends at each word; an n-gram of the highest order, or one that begins a sentence, keeps its count, any other counts the
different words to its left, taken from the order above. Three discounts for each order come from its counts of counts,
with 0.5, 1 and 1.5 where those give none. What the discounts take from a context goes to its next shorter one, down to a
uniform share of the vocabulary, ``</s>`` and ``<unk>``.

Each order is written as a table before the next one reads it, so nothing is counted twice. Counts are summed within tasks
before the shuffle, a context's sums likewise, so a frequent word's contexts are one row a task; joins with them have one row
for each n-gram and context on one side, and adaptive execution splits a context that holds very many n-grams. Four counts
of counts for each order are all that the driver gets. Words that look like the three marks are skipped; sentences without
words are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .search import few

START, END, UNKNOWN = "<s>", "</s>", "<unk>"
_FALLBACK = (0.5, 1.0, 1.5)


def _kept(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(START, END, UNKNOWN) & (w != ""))


def _grams(sentences: DataFrame, order: int) -> DataFrame:
    """(g, n, c): the longest n-gram of up to ``order`` words that ends at each word or end of (words, weight), with its weight."""
    padded = F.concat(F.array(F.lit(START)), F.col("w"), F.array(F.lit(END)))

    def ending(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), F.size(x)), lambda i: bound(F.least(i, F.lit(order)), lambda n: F.struct(F.array_join(F.slice(x, i - n + 1, n), " ").alias("g"), n.alias("n"))))

    some = sentences.select(_kept(F.col("words")).alias("w"), F.col("weight").cast("long").alias("weight")).where("size(w) > 0")
    each = some.select("weight", F.explode(bound(padded, ending)).alias("x"))
    return each.groupBy(F.col("x.g").alias("g"), F.col("x.n").alias("n")).agg(F.sum("weight").alias("c"))


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams were counted 1, 2, 3 and 4 times."""
    if not all(seen):
        return _FALLBACK
    y = seen[0] / (seen[0] + 2 * seen[1])
    out = tuple(j - (j + 1) * y * seen[j] / seen[j - 1] for j in (1, 2, 3))
    return out if all(0 <= d <= j for j, d in enumerate(out, 1)) else _FALLBACK


class LanguageModel:
    """A model below ``path``: tables ``grams-n`` of (g, p, backoff), both probabilities, not logarithms."""

    def __init__(self, spark: SparkSession, path: str, order: int = 4):
        if order < 2:
            raise ValueError(f"an order of 2 or more is needed, not {order}")
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def grams(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams-{n}")

    def train(self, sentences: DataFrame) -> LanguageModel:
        """Fits the model to sentences (words, weight)."""
        full = self._kept(_grams(sentences, self.order), "full")
        counts = {self.order: full.where(F.col("n") == self.order).select("g", "c")}
        for n in range(self.order - 1, 0, -1):
            left = counts[n + 1].groupBy(F.substring_index("g", " ", -n).alias("g")).agg(F.count("*").alias("c"))
            counts[n] = self._kept(left.unionByName(full.where(F.col("n") == n).select("g", "c")), f"counts-{n}")
        found: DataFrame | None = None
        backoff: DataFrame | None = None
        shares: dict[int, DataFrame] = {}
        for n in range(1, self.order + 1):
            seen = counts[n].agg(*(F.count_if(F.col("c") == k).alias(f"t{k}") for k in (1, 2, 3, 4))).first()
            d = discounts(list(seen))
            off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            own = counts[n].select("g", "c", off.alias("d"), (F.substring_index("g", " ", n - 1) if n > 1 else F.lit("")).alias("h"))
            # of each context: what was counted and what the discounts took, each kind of count by itself so that sums are exact
            per = own.groupBy("h").agg(F.sum("c").alias("all"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2)), F.count_if(F.col("c") > 2).alias("n3"))
            taken = (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("all")
            backoff = self._kept(per.select("h", "all", taken.alias("taken")), f"contexts-{n}")
            if n == 1:
                size = counts[1].count() + 1  # and <unk>
                base = own.crossJoin(F.broadcast(backoff.drop("h")))  # the empty context: one row
                share = F.col("taken") / size
                known = base.select("g", ((F.col("c") - F.col("d")) / F.col("all") + share).alias("p"))
                marks = backoff.select(F.explode(F.array(F.struct(F.lit(UNKNOWN).alias("g"), share.alias("p")), F.struct(F.lit(START).alias("g"), F.lit(1.0).alias("p")))).alias("x")).select("x.*")
                found = self._kept(known.unionByName(marks), "p-1")
            else:
                lower = found.select(F.col("g").alias("s"), F.col("p").alias("q"))
                # what a join doesn't need of an n-gram is worked out behind it, not carried through its shuffle
                met = counts[n].select("g", "c", F.substring_index("g", " ", 1 - n).alias("s")).join(lower, "s").select("g", "c", "q", F.substring_index("g", " ", n - 1).alias("h")).join(backoff, "h")
                found = met.select("g", ((F.col("c") - off) / F.col("all") + F.col("taken") * F.col("q")).alias("p"))
                found = self._kept(found, f"p-{n}") if n < self.order else found  # the last order's are written once, by _finish
            shares[n] = found
            if n > 1:
                self._finish(n - 1, shares[n - 1], backoff)
        self._finish(self.order, shares[self.order], None)
        return self

    def _finish(self, n: int, found: DataFrame, above: DataFrame | None) -> None:
        if above is None:
            self._kept(found.withColumn("backoff", F.lit(1.0)), f"grams-{n}")
        else:
            self._kept(found.join(above.select(F.col("h").alias("g"), F.col("taken").alias("backoff")), "g", "left").fillna(1.0, ["backoff"]), f"grams-{n}")

    def rows(self) -> DataFrame:
        """(n, g, logp, backoff) of all orders, in base-10 logarithms."""
        every = [self.grams(n).select(F.lit(n).alias("n"), "g", F.log10("p").alias("logp"), F.log10("backoff").alias("backoff")) for n in range(1, self.order + 1)]
        out = every[0]
        for one in every[1:]:
            out = out.unionByName(one)
        return out

    def write_arpa(self, path: str) -> None:
        """The model as an ARPA file: text parts that follow each other in the order of their names."""
        rows = self.rows()
        lines = rows.select(F.col("n").alias("section"), F.lit(1).alias("place"), "g", "logp", "backoff")
        sizes = {r.n: r["count"] for r in rows.groupBy("n").count().collect()}  # a row for each order
        head = [(0, 0, "", "\\data\\"), *((0, n, "", f"ngram {n}={sizes.get(n, 0)}") for n in range(1, self.order + 1))]
        for n in range(1, self.order + 1):
            head += [(n, 0, "", f"\n\\{n}-grams:")]
        head += [(self.order + 1, 0, "", "\n\\end\\")]
        marks = self.spark.createDataFrame(head, "section int, place int, g string, line string")
        last = F.when(F.col("section") == self.order, "").otherwise(F.concat(F.lit("\t"), F.col("backoff").cast("string")))
        line = F.coalesce("line", F.concat(F.col("logp").cast("string"), F.lit("\t"), "g", last))  # made behind the sort, so that an n-gram is shuffled once
        lines.unionByName(marks, allowMissingColumns=True).sort("section", "place", "g").select(line.alias("line")).write.text(path)

    def score(self, sentences: DataFrame, *key: str) -> DataFrame:
        """(``key``, n_words, n_unknown, logp) of sentences (``key``, words), in base-10 logarithms, ends of sentences included.

        ``key`` tells sentences apart. A word that the model doesn't know stands as ``<unk>``.
        """
        # a sentence's words stay in the task that its key is dealt to, where a vocabulary of few words meets them
        some = sentences.select(*key, F.concat(F.array(F.lit(START)), _kept(F.col("words")), F.array(F.lit(END))).alias("w")).repartition(*key)
        each = some.select(*key, F.posexplode("w").alias("at", "word"))
        logs = lambda n: [F.log10("p").alias(f"p{n}"), F.log10("backoff").alias(f"b{n}")]
        words = few(self.grams(1).select(F.col("g").alias("word"), *logs(1)))
        other = F.broadcast(self.grams(1).where(F.col("g") == UNKNOWN).select(F.log10("p").alias("p0"), F.log10("backoff").alias("b0")))  # one row
        each = each.join(words, "word", "left").crossJoin(other)
        known = F.col("p1").isNotNull()
        each = each.select(*key, "at", known.alias("known"), F.when(known, F.col("word")).otherwise(UNKNOWN).alias("w"), F.when(known, F.col("p1")).otherwise(F.col("p0")).alias("p1"), F.when(known, F.col("b1")).otherwise(F.col("b0")).alias("b1"))
        along = Window.partitionBy(*key).orderBy("at")
        past = F.collect_list("w").over(along.rowsBetween(1 - self.order, 0))
        each = each.select(*key, "at", "known", "p1", "b1", F.array_join(past, " ").alias("g"))
        nothing = F.concat(F.lit(" "), F.xxhash64(*key).cast("string"))  # is no n-gram, and another one for each sentence
        for n in range(2, self.order + 1):
            # an n-gram is looked up once: its own probability, and its backoff for the word that follows it
            mine = F.when(F.col("at") >= n - 1, F.substring_index("g", " ", -n)).otherwise(nothing)
            found = self.grams(n).select(F.col("g").alias("__g"), *logs(n)[: 2 if n < self.order else 1])
            each = each.withColumn("__g", mine).join(found, "__g", "left").drop("__g", *(["g"] if n == self.order else []))
        logp = F.col("p1")
        for n in range(2, self.order + 1):
            logp = F.coalesce(f"p{n}", F.coalesce(F.lag(f"b{n - 1}").over(along), F.lit(0.0)) + logp)
        each = each.select(*key, "at", "known", logp.alias("logp")).where("at > 0")
        return each.groupBy(*key).agg((F.count("*") - 1).alias("n_words"), F.count_if(~F.col("known")).alias("n_unknown"), F.sum("logp").alias("logp"))


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, g, logp, backoff) of an ARPA file; a missing backoff is 0."""
    cut = F.split("value", "\t")
    lines = spark.read.text(path).where(F.col("value").contains("\t")).select(cut.alias("f"))
    return lines.select(F.size(F.split(F.col("f")[1], " ")).alias("n"), F.col("f")[1].alias("g"), F.col("f")[0].cast("double").alias("logp"), F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(0.0)).alias("backoff"))
