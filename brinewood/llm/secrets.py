"""Secret scans: credential spans in whole texts, told apart by corpus-wide ownership frequency.

Main path: DataFrame functions only; no row leaves the JVM.

Cases: a null text counts as empty and has no spans; very long texts are scanned whole; rows without owner share the
owner null; repeated rows are scanned one by one but count once per owner and repository; spans that start together come
in the order of KINDS; columns of docs ride in the struct `row`, so their names can't clash; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm.common import materialize, spread_join, table


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the base kinds: keyword in either case and value; access key; hexadecimal run.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(_either, WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6  # characters of the value at least; shorter matches are dropped after matching
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of 20 or more is the same run that a match without length would take
HEX = "[0-9a-f]{24,}"
#: What the ownership frequency adds: long runs with upper case, lower case and digits, if few owners have them.
MIXED = "[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,kind:int,end:int,key:bigint>>"
JUDGED = "array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repos:bigint>>"


def _spans(text: Column, pattern: str, maybe: Column, kind: int, value, keep) -> Column:
    """Leftmost non-overlapping matches that `keep` accepts, as structs of SPAN, in code points.

    Gaps (split) and matches (extract) alternate, so running lengths give the places. Only texts for which
    `maybe` holds pay for that.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    none = F.array().cast(SPAN)
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["hit"])).alias("at"),
            F.when(
                keep(x["hit"]),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(kind).alias("kind"),
                            (acc["at"] + x["gap"] + F.length(x["hit"])).alias("end"),
                            F.xxhash64(value(x["hit"])).alias("key"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(maybe, walked).otherwise(none)


def find(text: Column) -> Column:
    """All candidates of a text: base spans, and mixed runs outside them; by start, then kind as in KINDS."""
    text = F.coalesce(text, F.lit(""))
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    whole = lambda m: m
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, text.rlike(ASSIGN), 0, assigned, lambda m: F.length(assigned(m)) >= ASSIGN_VALUE),
            _spans(text, ACCESS, text.contains("AKIA"), 1, whole, lambda m: F.lit(True)),
            _spans(text, HEX, text.rlike(HEX), 2, whole, lambda m: F.lit(True)),
            _spans(text, MIXED, text.rlike(MIXED), 3, whole, lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
        )
    )


def ownership(found: DataFrame) -> DataFrame:
    """found(owner, repo, spans) -> (key, n_owners, n_repos) of each candidate hash, over the whole corpus.

    A hash that a third of all rows hold is combined per partition first: to (key, owner, repository), then to
    (key, owner), then to key.
    """
    rows = found.where(F.size("spans") > 0).select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["key"]))).alias("key"), "owner", "repo")
    per_owner = rows.groupBy("key", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("key", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("key").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = 3, copied_repos: int = 100, keep_text: bool = False) -> DataFrame:
    """Rows (row, spans): the input row and its spans (start, kind, end, live, owners, repos), by start, then kind.

    A candidate that at least `copied_owners` owners hold, or two owners in at least `copied_repos` repositories, is a
    widely copied example; any other looks live. Base spans stay either way; a mixed run becomes a span of kind `owned`
    only if it looks live and lies outside the base spans.

    Texts are scanned once, and written with their spans only if they have any; with keep_text, rows without candidates
    are read anew instead of being written with their texts.
    """
    kept = [c for c in docs.columns if keep_text or c != text_col]
    row = F.struct(*kept).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    fields = [row, F.col(owner_col).alias("owner"), F.col(repo_col).cast("string").alias("repo"), find(text).alias("spans")]
    if keep_text:
        maybe = text.rlike(ASSIGN) | text.contains("AKIA") | text.rlike(HEX) | text.rlike(MIXED)
        without = docs.where(~maybe).select(row, F.array().cast(JUDGED).alias("spans"))
        some = materialize(docs.where(maybe).select(*fields).withColumn("rid", F.monotonically_increasing_id()), "secrets")
    else:
        found = materialize(docs.select(*fields).withColumn("rid", F.monotonically_increasing_id()), "secrets")
        without = found.where(F.size("spans") == 0).select("row", F.array().cast(JUDGED).alias("spans"))
        some = found.where(F.size("spans") > 0)
    keys = some.select("rid", F.explode(F.array_distinct(F.transform("spans", lambda s: s["key"]))).alias("key"))
    # collected per row, never per key
    told = spread_join(keys, ownership(some), "key").groupBy("rid").agg(F.collect_list(F.struct("key", F.struct("n_owners", "n_repos").alias("n"))).alias("told"))
    judged = some.join(told, "rid", "left").withColumn("told", F.map_from_entries(F.coalesce("told", F.array().cast("array<struct<key:bigint,n:struct<n_owners:bigint,n_repos:bigint>>>"))))

    def judge(s: Column) -> Column:
        owners, repos = F.col("told")[s["key"]]["n_owners"], F.col("told")[s["key"]]["n_repos"]
        live = ~((owners >= copied_owners) | ((owners >= 2) & (repos >= copied_repos)))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), live.alias("live"), owners.alias("owners"), repos.alias("repos"))

    judged = judged.withColumn("base", F.filter("spans", lambda s: s["kind"] < 3)).withColumn("all", F.transform("spans", judge))
    outside = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    judged = judged.select("row", F.filter("all", lambda s: (s["kind"] < 3) | (s["live"] & outside(s))).cast(JUDGED).alias("spans"))
    return without.unionByName(judged)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with every span replaced by <secret:kind> if it looks live, else by <example:kind>.

    Spans that overlap are replaced as one, under the name of the first. Rows without spans stay as they are;
    of the other columns only n_chars follows the text.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.col(f"row.`{text_col}`")
    # pieces between spans, walked by start; a span that begins before the last end only extends it
    walk = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["live"], F.lit("<secret:")).otherwise(F.lit("<example:")), F.get(names, s["kind"]), F.lit(">")),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    judged = scan(docs, text_col=text_col, keep_text=True, **options)
    new = judged.withColumn("_new", F.when(F.size("spans") > 0, walk).otherwise(text))
    out = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        out.append((F.col("_new") if c == text_col else F.when(F.size("spans") > 0, F.length("_new")).otherwise(old).cast(docs.schema[c].dataType) if c == "n_chars" else old).alias(c))
    return new.select(*out)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(of_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0).cast("long")).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repos"])), F.lit(0).cast("long")).alias("most_repos"),
    )


def _oracle() -> str:
    def kind(k: int, pattern: str, keep: str, value: str) -> str:
        p = pattern.replace("'", "''")
        lengths = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
        places = f"list_transform(range(1, len(hits) + 1), lambda i: {lengths.format('gaps[1:i]')} + {lengths.format('hits[1:i - 1]')})"
        return f"""
  SELECT doc_id, source, {k} AS kind, s::BIGINT AS s, (s + length(hit))::BIGINT AS e, {value.format(p=p)} AS v FROM (
    SELECT doc_id, source, unnest({places}) AS s, unnest(hits) AS hit FROM (
      SELECT doc_id, source, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps
      FROM docs WHERE regexp_matches(t, '{p}')))
  WHERE {keep.format(p=p)}"""

    kinds = [
        kind(0, ASSIGN, f"length(regexp_extract(hit, '{{p}}', 2)) >= {ASSIGN_VALUE}", "regexp_extract(hit, '{p}', 2)"),
        kind(1, ACCESS, "true", "hit"),
        kind(2, HEX, "true", "hit"),
        kind(3, MIXED, "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')", "hit"),
    ]
    names = "['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e"
    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
owners AS (SELECT v, count(DISTINCT coalesce('x' || source, '')) AS owners, count(DISTINCT coalesce('x' || source, '') || chr(0) || coalesce('x' || doc_id, '')) AS repos FROM found GROUP BY v),
judged AS (SELECT f.*, owners, repos, NOT (owners >= 3 OR owners >= 2 AND repos >= 100) AS live FROM found f JOIN owners USING (v)),
kept AS (SELECT * FROM judged j WHERE kind < 3 OR live AND NOT EXISTS (
  SELECT 1 FROM judged b WHERE b.doc_id = j.doc_id AND b.kind < 3 AND b.s < j.e AND j.s < b.e)),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({names}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({names}, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM docs LEFT JOIN per_doc USING (doc_id)"""


ORACLE = _oracle()
