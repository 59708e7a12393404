"""Ranked full-text search over four kinds of records, with queries themselves in a table."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklog.sources.shared import remove, scratch, stored


def _plain(char: str) -> str | None:
    """The letter that a letter with accents is made of, by Unicode's canonical decomposition."""
    base, *marks = unicodedata.normalize("NFD", char)
    return base if marks and all(unicodedata.category(m).startswith("M") for m in marks) else None


#: Letters with accents from Latin to Greek Extended, and the letters they are searched as.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x2000)) if _plain(c))
PLAIN = "".join(_plain(c) for c in ACCENTED)
WORD = r"[\p{L}\p{N}\p{M}]+"
K1, B, FLOOR = 1.2, 0.75, 1e-6
COLUMNS = ["project_id", "kind", "doc_id", "task_id", "body"]
RECORD = COLUMNS[:-1]


def search_corpus(tasks: DataFrame, progress: DataFrame, checkpoints: DataFrame, decisions: DataFrame) -> DataFrame:
    """project_id, kind, doc_id, task_id, body of every searchable record."""
    lists = F.array_join(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("done", "remaining", "notes")])), " ")
    parts = [
        tasks.select("project_id", F.lit("task").alias("kind"), F.col("id").alias("doc_id"), F.col("id").alias("task_id"), F.concat_ws(" ", "title", "description").alias("body")),
        progress.select("project_id", F.lit("progress").alias("kind"), F.col("id").alias("doc_id"), "task_id", F.col("content").alias("body")),
        checkpoints.select("project_id", F.lit("checkpoint").alias("kind"), F.col("id").alias("doc_id"), "task_id", lists.alias("body")),
        decisions.select("project_id", F.lit("decision").alias("kind"), F.col("id").alias("doc_id"), "task_id", F.concat_ws(" ", "title", "context", "decision_body", "consequences", "rationale").alias("body")),
    ]
    return union_hits(*parts)


def union_hits(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case, without accents, whether these are part of a letter or marks behind it.

    Marks are part of runs and letters stay letters, so the whole text is made plain at once.
    """
    return F.regexp_extract_all(_bare(text), F.lit(WORD), F.lit(0))


def _bare(word: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(word, r"\p{M}+", ""), ACCENTED, PLAIN))


def _tokenised(corpus: DataFrame) -> DataFrame:
    return corpus.select("project_id", "kind", "doc_id", "task_id", tokens(F.coalesce("body", F.lit(""))).alias("_t"))


def _in_runs(rows: DataFrame, column: str, key: str, made: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Add name: for each run of neighbours of an array with an equal key, what made gives of the first one and of the run.

    The key's last part alone may differ within a run; the array is sorted, so a run is all that there is of a key.
    """
    n, at = F.size(column), lambda i: F.get(F.col(column), i)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)[key] != at(i - 1)[key]))
    rows = rows.withColumn("_starts", F.when(n > 0, first).otherwise(F.array().cast("array<int>")))
    run = lambda i, k: F.slice(column, i + 1, F.coalesce(F.get("_starts", k + 1), n) - i)
    return rows.withColumn(name, F.transform("_starts", lambda i, k: made(at(i), run(i, k)))).drop("_starts")


def _grouped(tokenised: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
    """RECORD, doc_len, bucket, terms: the terms of each record in a bucket, each with its positions.

    Tokens are sorted and grouped within their record, so they don't move; only records that a corpus has in several rows
    of one length are put together.
    """
    place = lambda t, i: F.struct(F.struct(bucket(t).alias("bucket"), t.alias("term")).alias("key"), i.alias("pos"))
    rows = tokenised.select(*RECORD, F.size("_t").alias("doc_len"), F.sort_array(F.transform("_t", place)).alias("_s"))
    rows = _in_runs(rows, "_s", "key", lambda first, run: F.struct(first["key"]["bucket"].alias("bucket"), F.struct(first["key"]["term"].alias("term"), run["pos"].alias("positions")).alias("posting")), "_p").drop("_s")
    rows = _in_runs(rows, "_p", "bucket", lambda first, run: F.struct(first["bucket"].alias("bucket"), run["posting"].alias("terms")), "_b").drop("_p")
    # Outer, or else a filter on the size of the array would work it out twice.
    return rows.select(*RECORD, "doc_len", F.explode_outer("_b").alias("_b")).select(*RECORD, "doc_len", "_b.bucket", "_b.terms").filter("terms IS NOT NULL")


def _merged(grouped: DataFrame) -> DataFrame:
    """Rows of _grouped of the same record and length as one."""
    opened = grouped.select(*RECORD, "doc_len", "bucket", F.inline("terms"))
    postings = opened.groupBy(*RECORD, "doc_len", "bucket", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return postings.groupBy(*RECORD, "doc_len", "bucket").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("terms"))


def _term_lists(tokenised: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
    """What _grouped gives, with a record's rows put together where a corpus has several."""
    twice = stored(tokenised.groupBy(*RECORD).count().filter("count > 1").select(*RECORD), "doubled-records")
    if twice.isEmpty():
        return _grouped(tokenised, bucket)
    same = reduce(lambda a, b: a & b, [tokenised[c].eqNullSafe(twice[c]) for c in RECORD])
    return _grouped(tokenised.join(twice, same, "left_anti"), bucket).unionByName(_merged(_grouped(tokenised.join(twice, same, "left_semi"), bucket)))


def _opened(lists: DataFrame) -> DataFrame:
    """A row for each posting of _term_lists."""
    others = [c for c in lists.columns if c not in (*RECORD, "doc_len", "terms")]
    return lists.select(*RECORD, "doc_len", *others, F.explode_outer("terms").alias("_p")).select(*RECORD, "_p.term", "doc_len", "_p.positions", *others)


def build_index(corpus: DataFrame) -> DataFrame:
    """project_id, kind, doc_id, task_id, term, positions, doc_len: a posting for each term of each record."""
    return _opened(_term_lists(_tokenised(corpus), lambda t: F.lit(0))).drop("bucket")


class StoredIndex:
    """An index as two tables below a path: postings by buckets of terms (a record's of one bucket in one row), documents
    (each record, its length and the buckets of its terms) by buckets of records. A refresh writes only the buckets that
    changed records have or had."""

    DOC = ["project_id", "kind", "doc_id"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, *columns: Column | str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def write(self, corpus: DataFrame) -> StoredIndex:
        """Write the whole index anew. The corpus is taken apart once."""
        with scratch(self.spark):
            for name, df in self._parts(stored(_tokenised(corpus), "tokenised")).items():
                df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return self

    def _parts(self, tokenised: DataFrame) -> dict[str, DataFrame]:
        terms = F.array_sort(F.array_distinct(F.transform("_t", lambda t: self._bucket(t))))
        documents = tokenised.select(*self.DOC, "task_id", F.size("_t").alias("doc_len"), terms.alias("term_buckets"), self._bucket(*self.DOC).alias("bucket"))
        return {"postings": _term_lists(tokenised, self._bucket), "documents": documents}

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def postings(self) -> DataFrame:
        """What build_index gives."""
        return _opened(self._lists())

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def stats(self) -> DataFrame:
        """What index_stats gives, from the stored lengths."""
        return self.documents.groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))

    def postings_of(self, leaves: DataFrame) -> DataFrame:
        """The postings that leaves of queries can meet: of the buckets of their terms, or of all where one has a prefix."""
        asked = leaves.filter("error IS NULL").select("is_prefix", F.explode("terms").alias("term")).select("is_prefix", self._bucket("term").alias("bucket")).distinct().collect()
        return self.postings if any(r.is_prefix for r in asked) else _opened(self._lists().filter(F.col("bucket").isin(sorted({r.bucket for r in asked}))))

    def refresh(self, changed: DataFrame) -> None:
        """Replace the records that changed has, by project, kind and identifier; a null body removes one.

        What a bucket will hold is written aside first and then put in its place, so a refresh that was broken off can be
        run again.
        """
        with scratch(self.spark):
            keys = stored(changed.select(*self.DOC).distinct(), "changed-records")
            new = self._parts(stored(_tokenised(changed.filter("body IS NOT NULL")), "tokenised"))
            old = self.documents.join(keys.withColumn("bucket", self._bucket(*self.DOC)), [*self.DOC, "bucket"], "left_semi")
            terms = old.select(F.explode("term_buckets").alias("bucket")).union(new["postings"].select("bucket")).distinct()
            records = keys.select(self._bucket(*self.DOC).alias("bucket")).distinct()
            for name, touched in (("postings", terms), ("documents", records)):
                numbers = sorted(r.bucket for r in touched.collect())
                kept = self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("bucket").isin(numbers)).join(keys, self.DOC, "left_anti")
                after = stored(kept.unionByName(new[name]), name)
                after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
                for bucket in {*numbers} - {r.bucket for r in after.select("bucket").distinct().collect()}:
                    remove(self.spark, f"{self.path}/{name}/bucket={bucket}")


def refresh_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the postings of changed records replaced; a null body removes a record."""
    keys = ["project_id", "kind", "doc_id"]
    return index.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(build_index(changed.filter("body IS NOT NULL")).select(index.columns))


def index_stats(corpus: DataFrame) -> DataFrame:
    """kind, n_docs, avg_len over whole tables."""
    return corpus.select("kind", F.size(tokens(F.coalesce("body", F.lit("")))).alias("_n")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("_n").alias("avg_len"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """query_id, leaf, group_no, negated, terms, is_prefix, error: the flat leaves of queries (query_id, text).

    Quoted parts are phrases; other words with characters beyond letters, digits and _ become phrases too; AND, OR and
    NOT in capitals are operators; a star at the end makes the last term a prefix. Groups are joined by OR; in a group
    all leaves have to match, and the negated ones must not. Queries that begin or end with an operator, have two in a
    row, an unclosed quote or nothing to search for have an error and no leaves.
    """
    pieces = F.filter(F.regexp_extract_all("text", F.lit(r'"(?:[^"]|"")*"\*?|[^\s"]+'), F.lit(0)), lambda p: F.length(p) > 0)
    bad_quote = F.pmod(F.length(F.regexp_replace("text", '[^"]', "")), F.lit(2)) == 1
    rows = queries.select("query_id", "text", pieces.alias("_p"), bad_quote.alias("_q"))
    operators = ["AND", "OR", "NOT"]
    is_op = lambda p: p.isin(operators)
    ends = is_op(F.element_at("_p", -1)) | is_op(F.element_at("_p", 1))
    twice = F.exists(F.sequence(F.lit(1), F.greatest(F.size("_p") - 1, F.lit(1))), lambda i: (i < F.size("_p")) & is_op(F.get("_p", i - 1)) & is_op(F.get("_p", i)))
    nothing = F.size(F.flatten(F.transform(F.filter("_p", lambda p: ~is_op(p)), tokens))) == 0
    error = F.when(F.size("_p") == 0, "empty").when(F.col("_q"), "unclosed quote").when(ends, "operator at an end").when(twice, "two operators").when(nothing, "nothing to search for")
    rows = rows.withColumn("error", error)
    opened = rows.select("query_id", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_p"))).alias("_i", "_w"))
    order = Window.partitionBy("query_id").orderBy("_i")
    marked = opened.withColumns({"group_no": F.sum(F.when(F.col("_w") == "OR", 1).otherwise(0)).over(order), "negated": F.coalesce(F.lag("_w").over(order) == "NOT", F.lit(False))})
    leaf = marked.filter(F.col("_w").isNull() | ~is_op(F.col("_w")))
    return leaf.select(
        "query_id", F.coalesce("_i", F.lit(0)).alias("leaf"), F.coalesce("group_no", F.lit(0)).alias("group_no"), "negated", tokens(F.coalesce("_w", F.lit(""))).alias("terms"), F.coalesce(F.col("_w").endswith("*"), F.lit(False)).alias("is_prefix"), "error"
    ).filter(F.col("error").isNotNull() | (F.size("terms") > 0))


def match_leaves(index: DataFrame, leaves: DataFrame) -> DataFrame:
    """query_id, leaf, kind, doc_id, project_id, task_id, doc_len, hits: how often each leaf occurs in each record.

    Each term of a leaf is joined to the postings; the positions, shifted back by the term's place, meet in those where
    the phrase starts. A prefix is joined to the terms of the dictionary that begin with it,
    whose number alone, and not that of all terms, tells how many rows go on. The terms that are wanted are stored, so
    Spark knows how few they are and leaves the postings where they are.
    """
    keys = ["query_id", "leaf", "project_id", "kind", "doc_id", "task_id", "doc_len"]
    asked = leaves.filter("error IS NULL").select("query_id", "leaf", "is_prefix", F.size("terms").alias("_n"), F.posexplode("terms").alias("_place", "_term"))
    last = F.col("is_prefix") & (F.col("_place") == F.col("_n") - 1)
    exact = asked.filter(~last).select("query_id", "leaf", "_n", "_place", F.col("_term").alias("term"))
    prefix = asked.filter(last).withColumn("_len", F.length("_term"))
    wanted, lengths = exact, [r["_len"] for r in prefix.select("_len").distinct().collect()]
    if lengths:  # terms of the dictionary, cut to the lengths that are asked for, are equal to their prefixes
        prefix = stored(prefix, "prefixes")
        cut = index.select("term", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_len")).filter(F.char_length("term") >= F.col("_len"))
        begun = cut.withColumn("_term", F.left("term", F.col("_len"))).join(prefix, ["_term", "_len"])
        wanted = exact.unionByName(begun.select("query_id", "leaf", "_n", "_place", "term").distinct())
    found = index.join(stored(wanted, "wanted-terms"), "term").select(*keys, "_n", "_place", F.transform("positions", lambda p: p - F.col("_place")).alias("_at"))
    merged = found.groupBy(*keys, "_n", "_place").agg(F.array_distinct(F.flatten(F.collect_list("_at"))).alias("_at"))
    meet = merged.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_places"), F.collect_list("_at").alias("_all")).filter("_places = _n")
    starts = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1))), F.element_at("_all", 1), lambda a, b: F.array_intersect(a, b))
    return meet.withColumn("hits", F.size(starts)).filter("hits > 0").select(*keys, "hits")


def match_docs(hits: DataFrame, leaves: DataFrame) -> DataFrame:
    """query_id, group_no, project_id, kind, doc_id, task_id, doc_len: the satisfied groups of each record, from the hits of
    match_leaves."""
    groups = leaves.filter("error IS NULL")
    needed = groups.groupBy("query_id", "group_no").agg(F.count_if(~F.col("negated")).alias("_needed"))
    marked = hits.join(groups.select("query_id", "leaf", "group_no", "negated"), ["query_id", "leaf"])
    seen = marked.groupBy("query_id", "group_no", "project_id", "kind", "doc_id", "task_id", "doc_len").agg(F.count_if(~F.col("negated")).alias("_have"), F.count_if("negated").alias("_bad"))
    return seen.join(needed, ["query_id", "group_no"]).filter("_have = _needed AND _needed > 0 AND _bad = 0").drop("_have", "_needed", "_bad")


def rank(index: DataFrame, leaves: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, project_id, kind, doc_id, task_id, score: BM25 by the kind's own statistics, lower is better.

    A phrase's rarity comes from the number of the kind's records that hold it; a phrase that is asked for twice counts
    twice; only satisfied groups count.
    """
    leaves = stored(leaves, "query-leaves")
    hits = stored(match_leaves(index, leaves), "search-hits")
    rarity = hits.groupBy("query_id", "leaf", "kind").agg(F.count(F.lit(1)).alias("_df")).join(stats, "kind")
    ratio = (F.col("n_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)
    rarity = rarity.select("query_id", "leaf", "kind", "avg_len", F.when(ratio > 1, F.log(ratio)).otherwise(FLOOR).alias("_idf"))
    positive = leaves.filter("error IS NULL AND NOT negated").select("query_id", "leaf", "group_no")
    keys = ["query_id", "project_id", "kind", "doc_id", "task_id"]
    satisfied = match_docs(hits, leaves).select(*keys, "group_no")
    scored = hits.join(positive, ["query_id", "leaf"]).join(satisfied, [*keys, "group_no"]).join(rarity, ["query_id", "leaf", "kind"])
    f, length = F.col("hits"), F.col("doc_len") / F.col("avg_len")
    part = F.col("_idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * length))
    return scored.groupBy(*keys).agg((-F.sum(part)).alias("score"))


def _occurs(asked: Column, at: Column) -> Column:
    """Whether the terms of a leaf stand in _norm from a place on; the last one of a prefix needs only begin so."""
    terms = asked["terms"]
    n = F.size(terms)
    there = F.slice("_norm", at + 1, n)
    begins = (F.slice(there, 1, n - 1) == F.slice(terms, 1, n - 1)) & F.get(there, n - 1).startswith(F.get(terms, n - 1))
    return F.coalesce(F.when(asked["is_prefix"], begins).otherwise(there == terms), F.lit(False))


def snippet(hits: DataFrame, corpus: DataFrame, leaves: DataFrame, n: int = 12) -> DataFrame:
    """Add a snippet of at most n words, matches in brackets and ... at cut ends; for few rows.

    Words, phrases and prefixes are marked, phrases as one; matches that overlap share their brackets. The window holds
    most of the different leaves, then comes first; it begins n // 3 words before a match where the text allows. A corpus
    may have parts, an array of a record's columns: the one with the best window is shown, else body.
    """
    hits = stored(hits, "shown-hits")  # few, so the texts stay where they are, and the search runs once
    wanted = leaves.filter("error IS NULL AND NOT negated").groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("terms", "is_prefix"))).alias("_asked"))
    parts = F.col("parts") if "parts" in corpus.columns else F.array("body")
    keys = ["query_id", "project_id", "kind", "doc_id"]
    texts = corpus.select("project_id", "kind", "doc_id", F.posexplode(parts).alias("_part", "_text"))
    rows = stored(hits.select(*keys).distinct().join(texts, ["project_id", "kind", "doc_id"]), "shown-texts").join(wanted, "query_id")
    word = lambda p: F.regexp_extract(p, WORD, 0)
    pieces = F.filter(F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(rf"{WORD}[^\p{{L}}\p{{N}}\p{{M}}]*"), F.lit(0)), lambda p: _bare(word(p)) != "")
    rows = rows.withColumn("_p", pieces).withColumn("_norm", F.transform("_p", lambda p: _bare(word(p))))
    places = F.sequence(F.lit(0), F.greatest(F.size("_norm") - 1, F.lit(0)))
    found = lambda a, leaf: F.transform(F.filter(places, lambda s: _occurs(a, s)), lambda s: F.struct(leaf.alias("leaf"), s.alias("s"), (s + F.size(a["terms"])).alias("e")))
    rows = rows.withColumn("_found", F.flatten(F.transform("_asked", found)))
    begin = lambda s: F.greatest(F.lit(0), F.least(s - n // 3, F.size("_norm") - n))
    held = lambda w: F.size(F.array_distinct(F.transform(F.filter("_found", lambda m: (m["s"] >= w) & (m["e"] <= w + n)), lambda m: m["leaf"])))
    windows = F.array_distinct(F.transform("_found", lambda m: begin(m["s"])))
    best = F.array_max(F.transform(windows, lambda w: F.struct(held(w).alias("leaves"), (-w).alias("w"))))
    rows = rows.withColumn("_best", F.coalesce(best, F.struct(F.lit(0).alias("leaves"), F.lit(0).alias("w")))).withColumn("_w", -F.col("_best.w"))
    rows = rows.withColumn("_near", F.filter("_found", lambda m: (m["e"] > F.col("_w")) & (m["s"] < F.col("_w") + n)))
    covered = lambda i: F.exists("_near", lambda m: (m["s"] <= i) & (i < m["e"]))
    joined = lambda i: F.exists("_near", lambda m: (m["s"] < i) & (i < m["e"]))

    def marked(piece: Column, j: Column) -> Column:
        i = F.col("_w") + j
        opens, closes = covered(i) & ((j == 0) | ~joined(i)), covered(i) & ((j == n - 1) | ~joined(i + 1))
        return F.concat(F.when(opens, "[").otherwise(""), word(piece), F.when(closes, "]").otherwise(""), F.regexp_replace(piece, f"^{WORD}", ""))

    cut = F.regexp_replace(F.array_join(F.transform(F.slice("_p", F.col("_w") + 1, n), marked), ""), r"\s+$", "")
    text = F.concat(F.when(F.col("_w") > 0, "...").otherwise(""), cut, F.when(F.col("_w") + n < F.size("_p"), "...").otherwise(""))
    shown = rows.groupBy(*keys).agg(F.max_by(text, F.struct(F.col("_best.leaves"), -F.col("_part"))).alias("snippet"))
    return hits.join(shown, keys, "left").select(*hits.columns, "snippet")


def search(index: DataFrame, stats: DataFrame, queries: DataFrame, tasks: DataFrame, checkpoints: DataFrame | None = None, worktrees: DataFrame | None = None, kinds: Sequence[str] | None = None, status: str | None = None, owner: str | None = None, limit: int = 20) -> DataFrame:
    """The best hits of each query over the kinds, with the owning task's display id and status and a branch.

    Hits are limited per kind, merged by score and limited again; scores of different kinds are merged as they are. The
    branch is the checkpoint's own, else that of the task's worktree.
    """
    scored = rank(index, parse_queries(queries), stats)
    owning = tasks.select("project_id", F.col("id").alias("task_id"), F.col("display_id").alias("task_display_id"), F.col("status").alias("task_status"), "owner_agent_id")
    if status:
        owning = owning.filter(F.col("task_status") == status)
    if owner:
        owning = owning.filter(F.col("owner_agent_id") == owner)
    hits = scored.filter(F.col("kind").isin(list(kinds))) if kinds else scored
    if status or owner:
        hits = hits.join(owning, ["project_id", "task_id"])
    order = [F.col("score"), F.col("kind"), F.col("project_id"), F.col("doc_id")]
    by_kind = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(*order))).filter(F.col("_r") <= limit)
    best = by_kind.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= limit).drop("_r")
    if not (status or owner):  # only the hits that are shown look for their tasks
        best = stored(best, "best-hits").join(owning, ["project_id", "task_id"], "left").select("project_id", "task_id", *[c for c in best.columns if c not in ("project_id", "task_id", "rank")], *owning.columns[2:], "rank")
    best = best.drop("owner_agent_id")
    branch = F.lit(None).cast("string")
    if checkpoints is not None:
        own = checkpoints.select("project_id", F.lit("checkpoint").alias("kind"), F.col("id").alias("doc_id"), F.col("branch").alias("_b1"))
        best, branch = best.join(own, ["project_id", "kind", "doc_id"], "left"), F.col("_b1")
    if worktrees is not None:
        tree = worktrees.filter("task_id IS NOT NULL").groupBy("project_id", "task_id").agg(F.max_by("branch", "bound_at").alias("_b2"))
        best, branch = best.join(tree, ["project_id", "task_id"], "left"), F.coalesce(branch, "_b2")
    return best.withColumn("branch", branch).drop("_b1", "_b2")

