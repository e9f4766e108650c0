"""Names of a table in texts: annotation by a join on first tokens, longest match wins, and routes read from it.

The table may have any size and is a DataFrame; Spark chooses how to join it by its measured size. Tokens are runs of
letters and digits in upper case, and a match is a run of whole tokens within a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = r"[\p{L}\p{N}]+"


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.upper(x), F.lit(TOKEN), F.lit(0))


def by_first_token(names: DataFrame, name_col: str) -> DataFrame:
    """(first, phrases): for each first token the phrases of the table, longest first, with the row of the table; of rows that
    are the same phrase the least stays."""
    rows = names.select(tokens(F.col(name_col)).alias("w"), F.struct(*names.columns).alias("entry")).where(F.size("w") > 0)
    rows = rows.groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).agg(F.min("entry").alias("entry"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "phrase", "entry")))
    return rows.groupBy(F.substring_index("phrase", " ", 1).alias("first")).agg(ordered.alias("phrases"), F.max("n").alias("most"))


def annotate(docs: DataFrame, names: DataFrame, *, id_col: str = "doc", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(id, line_no, at, n, lead, phrase, entry) of the matches in each text: `at` counts the text's tokens, `lead` those
    before the match on its line, `n` its own; entry is the row of `names`.

    Matches are taken from the left without overlap, the longest at each place. An id names one text; null and empty texts
    have no match, names without letters and digits match nothing. A token that most texts hold meets one row of the
    table; matches, not tokens, are collected per line.
    """
    table = by_first_token(names, name_col)
    longest = table.agg(F.max("most")).first()[0] or 1
    lines = docs.select(F.col(id_col).alias("id"), F.transform(F.split(text_col, "\n"), tokens).alias("lines"))
    before = F.aggregate("lines", F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + F.size(w)))
    lines = lines.select("id", F.posexplode(F.arrays_zip("lines", before.alias("before"))).alias("line_no", "x")).where("x.lines is not null")
    places = F.transform("x.lines", lambda w, i: F.struct(i.alias("lead"), w.alias("token"), F.slice(F.col("x.lines"), i + 1, F.lit(longest)).alias("next")))
    found = lines.select("id", "line_no", "x.before", F.explode(places).alias("p")).select("id", "line_no", "before", "p.*")
    met = found.join(table, F.col("token") == F.col("first"))
    hit = F.get(F.filter("phrases", lambda e: F.array_join(F.slice("next", F.lit(1), -e["less"]), " ") == e["phrase"]), F.lit(0))
    met = met.select("id", "line_no", "before", "lead", hit.alias("hit")).where("hit is not null")
    each = F.struct("lead", (-F.col("hit.less")).alias("n"), (F.col("before") + F.col("lead")).alias("at"), "hit.phrase", "hit.entry")
    rows = met.groupBy("id", "line_no").agg(F.array_sort(F.collect_list(each)).alias("all"))
    kind = rows.schema["all"].dataType.simpleString()
    apart = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out")),
        lambda acc, m: F.when(m["lead"] >= acc["end"], F.struct((m["lead"] + m["n"]).alias("end"), F.array_append(acc["out"], m).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return rows.select("id", "line_no", F.explode(apart).alias("m")).select("id", "line_no", "m.at", "m.n", "m.lead", "m.phrase", "m.entry")


#: Labels of a route, by what follows them. A line with both and no port is the head of a line of values.
LABELS = {"PORT OF LOADING": "from", "POL": "from", "PORT OF DISCHARGE": "to", "PORT OF DISCHARGING": "to", "POD": "to", "DESTINATION": "to"}


def routes(docs: DataFrame, ports: DataFrame, *, id_col: str = "doc", text_col: str = "text", name_col: str = "name", below: int = 3) -> DataFrame:
    """[RGX-05, RGX-18] (id, origin, destination, delivery, vessel) of texts, by the ports of a table: those behind their
    labels; else two neighbouring ports on one of the lines below a head of labels, behind a vessel's name, a third on
    the line being the delivery; else two neighbouring ports anywhere behind such a head. origin and the others are rows of `ports`.
    """
    spark = docs.sparkSession
    port = F.struct(*ports.columns)
    empty = F.lit(None).cast(ports.select(port.alias("p")).schema["p"].dataType)
    marks = spark.createDataFrame(list(LABELS.items()), "name string, kind string").select("name", "kind", empty.alias("port"))
    both = ports.select(F.col(name_col).alias("name"), F.lit("port").alias("kind"), port.alias("port")).unionByName(marks)
    found = annotate(docs, both, id_col=id_col, text_col=text_col).select("id", "line_no", "at", "n", "lead", "entry.kind", "entry.port")
    order = Window.partitionBy("id").orderBy("at")
    near = lambda k, c: F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order)
    touches = near(1, F.col("at") + F.col("n")) == F.col("at")
    line = Window.partitionBy("id", "line_no")
    head = F.max((F.col("kind") == "from").cast("int")).over(line) + F.max((F.col("kind") == "to").cast("int")).over(line) - 2 * F.max((F.col("kind") == "port").cast("int")).over(line)
    rows = found.withColumns({"before": F.when(touches & ((near(1, "kind") == "port") | (near(1, "line_no") == F.col("line_no"))), near(1, "kind")), "head_line": F.when(head == 2, F.col("line_no"))})
    rows = rows.withColumns({
        "head_line": F.last("head_line", True).over(order),
        "next": F.when((near(-1, "kind") == "port") & (near(-1, "at") == F.col("at") + F.col("n")), F.struct(near(-1, "port").alias("port"), near(-1, "line_no").alias("line_no"), (near(-1, "at") + near(-1, "n")).alias("end"))),
        "after": F.when(near(-2, "kind") == "port", F.struct(near(-2, "port").alias("port"), near(-2, "at").alias("at"), near(-2, "line_no").alias("line_no"))),
    })
    rows = rows.where("kind = 'port'").withColumn("open", F.coalesce(F.col("before") != "port", F.lit(True)) & F.col("next").isNotNull() & F.col("head_line").isNotNull())
    third = F.when((F.col("after.at") == F.col("next.end")) & (F.col("after.line_no") == F.col("next.line_no")), F.col("after.port"))
    pair = F.struct(F.col("port").alias("origin"), F.col("next.port").alias("destination"), F.coalesce(third, F.col("next.port")).alias("delivery"), "line_no", "lead")
    on_line = F.col("open") & (F.col("next.line_no") == F.col("line_no")) & (F.col("line_no") - F.col("head_line")).between(1, below) & (F.col("lead") > 0)
    first = lambda value, when: F.min_by(value, F.when(when, F.col("at")))
    told = rows.groupBy("id").agg(
        first(F.col("port"), F.col("before") == "from").alias("origin"), first(F.col("port"), F.col("before") == "to").alias("destination"),
        first(pair, on_line).alias("below"), first(pair, F.col("open") & (F.col("line_no") >= F.col("head_line"))).alias("loose"),
    )
    told = told.withColumn("pair", F.coalesce("below", "loose"))
    said = docs.select(F.col(id_col).alias("_id"), F.split(text_col, "\n").alias("_lines"))
    joined = told.join(said, F.col("id") == F.col("_id"))
    vessel = F.when(F.col("below").isNotNull(), F.array_join(F.slice(tokens(F.get("_lines", F.col("below.line_no"))), F.lit(1), F.col("below.lead")), " "))
    return joined.select("id", F.coalesce("origin", "pair.origin").alias("origin"), F.coalesce("destination", "pair.destination").alias("destination"), F.coalesce("pair.delivery", "destination").alias("delivery"), vessel.alias("vessel"))
