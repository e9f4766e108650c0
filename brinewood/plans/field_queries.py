"""Registered queries of the column functions: texts, numbers, ids and fields.

Where the tables hold no value of a kind, texts are put together from their columns; the SQL gives what has to be read out
of them again, from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewood.functions import fields, ids, numbers, parties, scored, text
from brinewood.operators.shape import computed
from brinewood.plans.registry import query, read

_UPPER = "translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_ALNUM = _UPPER.format("regexp_replace({0}, '[^A-Za-z0-9]+', '', 'g')")
_MATCH = "trim(regexp_replace(" + _UPPER + ", '[^A-Z0-9]+', ' ', 'g'))"


def _cut_at(head: str, sep: str) -> str:
    return f"CASE WHEN strpos(reverse({head}), reverse({sep})) > 0 THEN length({head}) - strpos(reverse({head}), reverse({sep})) - length({sep}) + 1 ELSE -1 END"


def _truncated(x: str, limit: int) -> str:
    head = f"substr({x}, 1, {limit})"
    steps = "".join(f" WHEN {_cut_at(head, s)} >= {int(limit * 0.6)} THEN rtrim(substr({head}, 1, {_cut_at(head, s)}), ' .,;' || chr(10))" for s in ("chr(10)", "'. '", "'; '", "', '"))
    return f"CASE WHEN length({x}) <= {limit} THEN {x}{steps} ELSE rtrim({head}, ' ') END"


# ---- strings -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_ALNUM.format('text')}) AS alnum, md5({_MATCH.format('text')}) AS matched FROM documents")
def text_keys(spark, sf_dir):
    """[STR-04, STR-05, STR-06, STR-18] Whole texts as letters and digits, and as words."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.alnum_upper(F.col("text"))).alias("alnum"), F.md5(text.match_text(F.col("text"))).alias("matched"))


@query(r"SELECT p_partkey, upper(regexp_replace(p_name || ' - ' || p_type || '/' || p_brand, '\s+', '', 'g')) AS compact FROM part")
def compact_names(spark, sf_dir):
    """[STR-07] Names without white space."""
    return read(spark, sf_dir, "part").select("p_partkey", text.compact_upper(F.concat("p_name", F.lit(" - "), "p_type", F.lit("/"), "p_brand")).alias("compact"))


@query(f"""
WITH d AS (SELECT doc_id, text, source, trim(text) AS t, trim(coalesce(source, '')) AS b FROM documents), m AS (SELECT *, CASE WHEN b = '' THEN t ELSE b || chr(10) || t END AS merged FROM d)
SELECT doc_id, md5(CASE WHEN length(t) > 200 THEN {_truncated('t', 200)} ELSE text END) AS capped, md5(CASE WHEN length(t) > 200 AND NOT contains(b, t) THEN {_truncated('merged', 400)} ELSE source END) AS notes FROM m""")
def notes_spill(spark, sf_dir):
    """[STR-11] What a capped text loses goes to the notes."""
    capped, notes = text.spill(F.col("text"), F.col("source"), 200, 400)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(capped).alias("capped"), F.md5(notes).alias("notes"))


@query(f"""
WITH d AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents), p AS (SELECT *, greatest({_cut_at('h', 'chr(10)')}, {_cut_at('h', "'. '")}, {_cut_at('h', "'; '")}) AS cut FROM d)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(CASE WHEN cut > 180 THEN rtrim(substr(h, 1, cut), ' .,;' || chr(10)) ELSE h END, ' ') END AS capped FROM p""")
def strict_truncate(spark, sf_dir):
    """[STR-12] Texts cut at the farthest boundary beyond 60 per cent."""
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate_strict(F.col("text"), 300).alias("capped"))


@query(r"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' S.T.C : ' || text WHEN 1 THEN 'stc-' || text ELSE text END AS x FROM documents),
r AS (SELECT doc_id, trim(x) AS t, trim(regexp_replace(trim(x), '(?i)^\s*S\.?\s*T\.?\s*C\.?\s*[:\-]?\s*', '')) AS rest FROM d)
SELECT doc_id, md5(CASE WHEN t <> '' THEN CASE WHEN rest = '' THEN 'S.T.C' ELSE 'S.T.C' || chr(10) || rest END END) AS prefixed FROM r""")
def said_to_contain(spark, sf_dir):
    """[STR-13] The prefix once, whether the text had it or not."""
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" S.T.C : "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("stc-"), "text")).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.with_prefix(x)).alias("prefixed"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'FOB' WHEN 1 THEN 'CIF' WHEN 2 THEN 'DAP' WHEN 3 THEN 'no FOBs given' END AS term FROM orders""")
def delivery_terms(spark, sf_dir):
    """[STR-14] Delivery terms as words."""
    k = F.col("o_orderkey") % 5
    x = F.when(k == 0, F.concat("o_orderpriority", F.lit(" fob port"))).when(k == 1, "Cif, then EXW").when(k == 2, F.lit("  terms:DAP")).when(k == 3, " no FOBs given ").otherwise("  ")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.incoterm(x).alias("term"))


@query("SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'Egypt' WHEN 1 THEN 'India' WHEN 2 THEN 'China' WHEN 3 THEN 'Turkey' END AS country FROM customer")
def address_countries(spark, sf_dir):
    """[STR-15] Countries of addresses."""
    k = F.col("c_nationkey") % 5
    place = F.when(k == 0, "12 Nile st, Cairo, eg").when(k == 1, "Plot 5, Noida, in").when(k == 2, "Ningbo, China").when(k == 3, "Izmir, TR").otherwise("Rotterdam")
    return read(spark, sf_dir, "customer").select("c_custkey", text.country(F.concat("c_name", F.lit(" "), place)).alias("country"))


@query(r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id || '.00' ELSE text END AS v FROM documents), f AS (SELECT doc_id, trim(regexp_replace(CASE WHEN regexp_matches(v, '^-?[0-9]+\.0+$') THEN regexp_replace(v, '\.0+$', '') ELSE v END, '\s+', ' ', 'g')) AS t FROM d)
SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS cell FROM f""")
def cell_texts(spark, sf_dir):
    """[STR-16] Texts and whole floats as cells."""
    v = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".00"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.cell_text(v).alias("cell"))


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 18278 + 1)::INT AS n FROM orders), a AS (SELECT *, (n - 1) // 26 AS m FROM o), b AS (SELECT *, CASE WHEN m > 0 THEN (m - 1) // 26 ELSE 0 END AS k FROM a)
SELECT o_orderkey, CASE WHEN k > 0 THEN chr((64 + k)::INT) ELSE '' END || CASE WHEN m > 0 THEN chr((65 + (m - 1) % 26)::INT) ELSE '' END || chr((65 + (n - 1) % 26)::INT) AS name, n AS place FROM b""")
def column_letters(spark, sf_dir):
    """[STR-17] Column numbers as letters and back."""
    name = text.column_name(F.col("o_orderkey") % 18278 + 1)
    named = read(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return named.withColumn("place", text.column_index(F.concat("name", F.lit("12"))).cast("int"))


@query("""
SELECT o_orderkey, (o_custkey % 50 + 1)::VARCHAR || CASE o_orderkey % 3 WHEN 0 THEN ' CARTON' WHEN 1 THEN ' PALLET' ELSE ' DRUM' END AS packages,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BAG' ELSE 'ROLL' END AS unit FROM orders""")
def package_counts(spark, sf_dir):
    """[STR-19, WIN-07] Counts with units, from a value or its page, and the unit inside outer units."""
    q, k = (F.col("o_custkey") % 50 + 1).cast("string"), F.col("o_orderkey") % 3
    value = F.when(k == 0, F.concat(q, F.lit(" ctns"))).when(k == 1, q).otherwise("")
    page = F.when(k == 1, F.concat(F.lit("IN ALL "), q, F.lit(" PALLETS"))).otherwise(F.concat(F.lit("TOTAL "), q, F.lit(" DRUMS")))
    inner = F.when(F.col("o_orderkey") % 2 == 0, "BAGS").otherwise("ROLLS")
    body = F.concat(F.lit("2 PALLETS SAID TO CONTAIN "), q, F.lit(" "), inner)
    return read(spark, sf_dir, "orders").select("o_orderkey", scored.packages(value, page).alias("packages"), scored.package_unit(body).alias("unit"))


_NOISE = r"regexp_replace({0}, '[|_\[\]{{}}~^]+', ' ', 'g')"
for _c in (".", ",", ";", ":", "-"):
    _NOISE = f"regexp_replace({_NOISE}, '\\{_c}{{{{3,}}}}', '{_c}', 'g')"
_NOISE = rf"nullif(trim(regexp_replace({_NOISE}, '\s+', ' ', 'g'), ' ,;:-'), '')"


@query(f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_NOISE.format('x')}), lambda x: x IS NOT NULL AND NOT contains(upper(x), 'LICENSE')) AS ls FROM documents)
SELECT doc_id, md5(nullif(array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10)), '')) AS notes FROM l""")
def notes_cleaned(spark, sf_dir):
    """[STR-20, STR-22] Lines of whole texts without residue, noise phrases and repetitions."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(parties.clean_notes(F.col("text"), ("license",))).alias("notes"))


@query("SELECT s_suppkey, CASE WHEN s_name LIKE '%7%' THEN 'Seven' WHEN s_name LIKE '%1%' THEN 'One' ELSE s_name END AS name FROM supplier")
def canonical_names(spark, sf_dir):
    """[STR-20] Names by canonical form."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", parties.canonical_name(F.col("s_name"), {"7": "Seven", "1": "One"}).alias("name"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' 5 Palm Street, Alexandria' WHEN 1 THEN c_mktsegment WHEN 2 THEN NULL ELSE c_name END AS address,
  (c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND c_mktsegment = 'BUILDING')) AS is_address, 'PORT ' || c_mktsegment AS place, (c_custkey % 4 = 3) AS is_party, c_custkey % 4 = 1 AS is_goods FROM customer""")
def addresses(spark, sf_dir):
    """[STR-21, FLT-11, FLT-12] Addresses up to contacts, doubled places, and what a text is."""
    k = F.col("c_custkey") % 4
    x = F.when(k == 0, F.concat("c_name", F.lit("  5 Palm Street, Alexandria Tel: 0123 Fax 5"))).when(k == 1, F.concat("c_mktsegment", F.lit(" tel 20 cartons"))).when(k == 2, "NOTIFY PARTY:").otherwise(F.col("c_name"))
    named = F.when(k == 3, "Blue Nile Trading").otherwise(x)
    port = F.concat(F.lit("Port "), F.initcap("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", parties.address(x).alias("address"), parties.is_address(x).alias("is_address"), parties.place(F.concat(port, F.lit(" "), port)).alias("place"),
        parties.plausible_party(named).alias("is_party"), parties.is_goods(x).alias("is_goods"),
    )


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS f FROM pages), s AS (SELECT page_id, regexp_replace(f, '[^A-Za-z0-9._-]+', '_', 'g') AS base, upper(regexp_replace(f, '\.[^.]*$', '')) AS stem FROM p)
SELECT page_id, CASE WHEN base = '' THEN 'upload' ELSE substr(base, 1, 140) END AS name, nullif(regexp_extract(stem, '([A-Z]*[0-9]{4,}[A-Z0-9]*)', 1), '') AS reference FROM s""")
def file_names(spark, sf_dir):
    """[STR-24, STR-25] File names of addresses, and the references in them."""
    return read(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"), text.file_stem_reference(F.col("url")).alias("reference"))


# ---- numbers -----------------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity::DECIMAL(18,4) AS q, l_extendedprice::DECIMAL(18,2) AS p FROM lineitem),
y AS (SELECT *, l_linenumber % 3 = 0 AS odd FROM x)
SELECT l_orderkey, l_linenumber, ((CASE WHEN odd THEN 1 ELSE q END) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::DOUBLE AS quantity,
  (CASE WHEN odd THEN round(q * (p + 0.0012), 2) ELSE p END)::DOUBLE AS price, 'FREIGHT|' || l_returnflag || '|' || q::INT::VARCHAR AS signature FROM y""")
def cost_line_values(spark, sf_dir):
    """[NUM-07, NUM-08] Quantities and prices that keep the amount, and the identity of a line."""
    q, odd = F.col("l_quantity").cast("decimal(18,4)"), F.col("l_linenumber") % 3 == 0
    p = F.col("l_extendedprice").cast("decimal(18,2)").cast("decimal(18,4)") + F.when(odd, F.lit("0.0012").cast("decimal(6,4)")).otherwise(F.lit("0").cast("decimal(6,4)"))
    quantity, price = numbers.cost_values(q * p, q, p, F.col("l_returnflag") == "R")
    signature = numbers.cost_signature(F.lit(" freight "), F.col("l_returnflag"), F.col("l_quantity").cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quantity.cast("double").alias("quantity"), price.cast("double").alias("price"), signature.alias("signature"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN l_linenumber WHEN 2 THEN 3 END::INT AS n FROM lineitem")
def originals_stated(spark, sf_dir):
    """[NUM-13] Stated numbers of originals."""
    k = F.col("l_linenumber") % 4
    x = F.when(k == 0, " zero (0)").when(k == 1, F.concat("l_linenumber", F.lit(" originals"))).when(k == 2, "THREE (3)").otherwise("none")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.original_count(x).alias("n"))


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '20DC' WHEN 1 THEN '40HC' WHEN 2 THEN '40DC' WHEN 3 THEN '45HC' END AS invoice, CASE p_size % 5 WHEN 0 THEN '20DC' WHEN 1 THEN '40HC' WHEN 2 THEN '40DC' END AS options,
  CASE WHEN p_size % 5 = 4 THEN '40RF' END AS other, CASE p_size % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN NULL ELSE -0.5 END AS number FROM part""")
def equipment_codes(spark, sf_dir):
    """[NUM-15, NUM-16] Equipment by mappings that disagree, and numbers or null."""
    k = F.col("p_size").cast("int") % 5
    x = F.when(k == 0, "20' dry").when(k == 1, "40 HQ").when(k == 2, "40' standard").when(k == 3, "45 ft").otherwise("flat")
    number = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise("-0.5")
    return read(spark, sf_dir, "part").select("p_partkey", ids.equipment(x, "invoice").alias("invoice"), ids.equipment(x, "options").alias("options"), ids.equipment(F.when(k == 4, "45R1 reefer"), "upload").alias("other"), number.try_cast("double").alias("number"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'D|' || upper(l_returnflag) || ' GOODS' ELSE 'Q||' || printf('%.3f', l_quantity) || '|' || CASE WHEN l_linenumber % 3 = 1 THEN printf('%.3f', l_tax) ELSE '' END END AS signature FROM lineitem""")
def quantity_signatures(spark, sf_dir):
    """[SET-07] The identity of cargo rows."""
    k = F.col("l_linenumber") % 3
    signature = numbers.quantity_signature(F.concat("l_returnflag", F.lit("- goods")), F.lit(None).cast("double"), F.when(k != 0, F.col("l_quantity")), F.when(k == 1, F.col("l_tax")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", signature.alias("signature"))


@query("""
SELECT o_orderkey, (o_custkey % 50) * 10 + 10.25::DOUBLE AS gross, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 + 1.5::DOUBLE END AS volume, printf('%.2f', 101.0 + o_custkey % 50) AS probe FROM orders""")
def best_weights(spark, sf_dir):
    """[WIN-03, FLT-09, SRC-07] The labelled weight among others, volumes, and the first weight pattern."""
    q = (F.col("o_custkey") % 50 + 1).cast("double")
    gross = F.concat(F.lit("NET 7.00 KGS\nGROSS WEIGHT: "), F.format_string("%.2f", q * 10 + 0.25), F.lit(" KGS\nTEL 2000 KG"))
    cubic = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("MEASUREMENT "), F.format_string("%.2f", q + 0.5), F.lit(" CBM\n90.00 CBM"))).otherwise("none")
    page = F.concat(F.lit("about 5 kg, "), F.format_string("%.2f", 100 + q), F.lit(" KGS and 500 KGS"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scored.gross_weight(gross).alias("gross"), scored.volume(cubic).alias("volume"), fields.weight_probe(page).alias("probe"))


@query(f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, ({' + '.join(f"contains(upper(part), '{w}')::INT" for w in ('THE', 'AND', 'LICENSE'))}) + least(length(part) / 400.0::DOUBLE, 5.0::DOUBLE) AS score FROM s)
SELECT doc_id, arg_max(part, (score, -i)) AS part FROM k GROUP BY 1""")
def best_sections(spark, sf_dir):
    """[WIN-04] The line of each document with most keywords."""
    return read(spark, sf_dir, "documents").select("doc_id", scored.best_section(F.col("text"), "\n", ["the", "and", "license"]).alias("part"))


# ---- sets of lines and codes -------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
l AS (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_concat(string_split(coalesce(x, ''), chr(10)), string_split(coalesce(y, ''), chr(10))), lambda v: trim(v) <> '') AS ls FROM c)),
k AS (SELECT *, {_ALNUM.format('line')} AS k FROM l),
r AS (SELECT conv_id, turn, i, trim(line) AS line FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.i <> a.i AND contains(b.k, a.k) AND (length(b.k) > length(a.k) OR b.i < a.i))),
j AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS notes FROM r GROUP BY 1, 2)
SELECT c.conv_id, c.turn, md5(notes) AS notes FROM c LEFT JOIN j ON c.conv_id = j.conv_id AND c.turn = j.turn""")
def notes_merged(spark, sf_dir):
    """[SET-05] Lines of a turn and the next, without those that others contain."""
    a = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return a.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.md5(text.merge_notes(F.col("text"), F.col("other"))).alias("notes"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN CASE WHEN list_has_all(string_split(upper(p_name), ' '), string_split(upper(p_type), ' ')) THEN p_name ELSE p_type || ', ' || p_name END WHEN 2 THEN p_name || chr(10) || p_brand ELSE p_name END AS merged FROM part")
def descriptions_merged(spark, sf_dir):
    """[SET-06] Descriptions of which one holds the other's words, and others joined."""
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.initcap("p_name")).when(k == 1, F.concat("p_type", F.lit(", "), "p_name")).when(k == 2, F.concat("p_brand", F.lit("\n"), "p_name")).otherwise(" ")
    own = F.when(k == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.col("p_name"))
    merged = F.when(k == 2, text.merge_descriptions(F.col("p_name"), F.col("p_brand"))).otherwise(text.merge_descriptions(own, other))
    return read(spark, sf_dir, "part").select("p_partkey", merged.alias("merged"))


@query("""
SELECT doc_id, CASE WHEN length(coalesce(source, '')) > length(coalesce(lang, '')) THEN source ELSE lang END AS longest, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN source || ' trading company' ELSE lang || ' x' END AS cleanest FROM documents""")
def better_names(spark, sf_dir):
    """[WIN-05] The longer of two values, and the cleaner of two names."""
    k = F.col("doc_id") % 3
    first = F.when(k == 0, "CONSIGNEE:").when(k == 1, F.concat("source", F.lit(" trading company"))).otherwise(F.concat("source", F.lit(" HS CODE 1234 gross weight")))
    second = F.when(k == 2, F.concat("lang", F.lit(" x"))).otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", text.longer(F.col("lang"), F.col("source")).alias("longest"), parties.cleaner_name(first, second).alias("cleanest"))


# ---- ids ---------------------------------------------------------------------------------------------------------


@query(r"""
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'ABC ' || o_custkey || '-77' WHEN 1 THEN 'original' WHEN 2 THEN 'ABCD' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0') WHEN 3 THEN '0' || lpad(o_custkey::VARCHAR, 6, '0')
  WHEN 4 THEN lpad(o_custkey::VARCHAR, 19, '1') WHEN 5 THEN 'ABCDEF' WHEN 6 THEN lpad(o_custkey::VARCHAR, 12, '2') ELSE 'ab' || o_custkey END AS x FROM orders),
c AS (SELECT *, upper(regexp_replace(x, '[\s\-]', '', 'g')) AS c FROM o)
SELECT o_orderkey, (length(c) BETWEEN 5 AND 25 AND c <> 'ORIGINAL' AND NOT regexp_matches(c, '^[A-Z]{4}[0-9]{7}$') AND NOT (regexp_matches(c, '^[0-9]+$') AND length(c) = 19) AND NOT regexp_matches(c, '^0[0-9]{6,8}$')
  AND CASE WHEN regexp_matches(c, '^[A-Z]+$') THEN false WHEN regexp_matches(c, '^[0-9]+$') THEN length(c) <= 20 ELSE true END) AS likely,
  regexp_matches(x, '^[A-Z]{2,}[A-Z0-9]*[0-9]{4,}[A-Z0-9]*$') AS billing, (length(trim(x)) BETWEEN 3 AND 15 AND regexp_matches(x, '[0-9]')) AS voyage, (o_orderkey % 8 = 3 OR o_orderkey % 8 = 6) AS form FROM c""")
def likely_ids(spark, sf_dir):
    """[FLT-01, FLT-03, FLT-04, FLT-07] What may be a document number, a billing number, a voyage, or a form's number."""
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    x = (
        F.when(k == 0, F.concat(F.lit("ABC "), c, F.lit("-77"))).when(k == 1, "original").when(k == 2, F.concat(F.lit("ABCD"), F.lpad((F.col("o_custkey") % 10_000_000).cast("string"), 7, "0")))
        .when(k == 3, F.concat(F.lit("0"), F.lpad(c, 6, "0"))).when(k == 4, F.lpad(c, 19, "1")).when(k == 5, "ABCDEF").when(k == 6, F.lpad(c, 12, "2")).otherwise(F.concat(F.lit("ab"), c))
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    page = F.when(F.col("o_orderkey") % 8 == 6, F.concat(F.lit("FMC NO: "), F.substring("x", 1, 9)))
    number = F.when(F.col("o_orderkey") % 8 == 6, F.substring("x", 1, 9)).otherwise(F.col("x"))
    return rows.select("o_orderkey", ids.likely_number(F.col("x")).alias("likely"), ids.billing_number(F.col("x")).alias("billing"), ids.likely_voyage(F.col("x")).alias("voyage"), ids.form_serial(number, page).alias("form"))


@query("""
WITH v AS (SELECT o_orderkey, 'V' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '0W' ELSE 'OW' END AS v FROM orders),
s AS (SELECT o_orderkey, [v, replace(v, 'OW', 'W'), replace(v, '0W', 'W'), replace(replace(v, 'O', '0'), '0W', 'W')] AS b FROM v)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(b, list_transform(b, lambda x: replace(x, 'O', '0')), list_transform(b, lambda x: replace(x, '0', 'O'))))), ',') AS spellings FROM s""")
def voyage_spellings(spark, sf_dir):
    """[JN-16] The spellings of voyages."""
    v = F.concat(F.lit(" v"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "0w").otherwise("oW"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ids.voyage_variants(v), ",").alias("spellings"))


@query("""
SELECT l_orderkey, l_linenumber, 'MSCU' || lpad(l_orderkey::VARCHAR, 7, '0') AS number, CASE WHEN l_linenumber % 2 = 0 THEN 'SL' || lpad(l_partkey::VARCHAR, 5, '0') END AS seal, '40HC' AS kind FROM lineitem""")
def containers_split(spark, sf_dir):
    """[JN-28] Container, seal and type out of one text."""
    number = F.concat(F.lit("mscu"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0"))
    seal = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" / SL"), F.lpad(F.col("l_partkey").cast("string"), 5, "0"))).otherwise("")
    parts = parties.split_container(F.concat(number, seal, F.lit(" / 40HC")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parts[0].alias("number"), F.trim(parts[1]).alias("seal"), parts[2].alias("kind"))


@query("""
WITH b AS (SELECT o_orderkey, 'MSCU' || lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') AS body FROM orders),
s AS (SELECT *, list_sum([(CASE WHEN i <= 4 THEN [24, 30, 13, 32][i] ELSE substr(body, i, 1)::INT END) * (1 << (i - 1)) FOR i IN range(1, 11)]) AS iso, list_sum([(CASE WHEN i <= 4 THEN [22, 28, 12, 30][i] ELSE substr(body, i, 1)::INT END) * (1 << (i - 1)) FOR i IN range(1, 11)]) AS own FROM b)
SELECT o_orderkey, d::INT AS digit, (iso % 11 % 10 = d) AS valid, CASE WHEN (own + d * 1024) % 11 % 10 = d THEN body || '-' || d ELSE body || d END AS shown FROM s, range(10) t(d)""")
def container_digits(spark, sf_dir):
    """[STR-08, FLT-02] All ten digits after a container's number: which is valid, and how each is shown."""
    body = F.concat(F.lit("MSCU"), F.lpad((F.col("o_orderkey") * 7919 % 1000000).cast("string"), 6, "0"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("digit"))
    full = F.concat("body", F.col("digit").cast("string"))
    return rows.select("o_orderkey", "digit", ids.iso6346_valid(full).alias("valid"), ids.format_container(full).alias("shown"))


# ---- fields of documents -----------------------------------------------------------------------------------------


def bills(spark, sf_dir):
    """Bills of lading put together from orders, one text each."""
    key = lambda n, fill: F.lpad(F.col("o_orderkey").cast("string"), n, fill)
    part = F.concat
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
        part(
            F.lit("Bill of Lading No: ORD"), key(8, "0"), F.lit("\nHBL No: HS"), F.col("o_custkey").cast("string"), F.lit("9000"),
            F.lit("\nSHIPPER:\nBlue Nile Trading\n5 Palm Street\nPort Said\nCONSIGNEE:\nDelta Imports\n9 Canal Road\nNOTIFY PARTY:\nDelta Imports\n\nVESSEL: SEA STAR  VOYAGE NO: V"), F.col("o_custkey").cast("string"), F.lit("W"),
            F.lit("\nPORT OF LOADING: Shanghai  PORT OF DISCHARGE: Port Said"), F.lit("\nACID NO: "), key(19, "7"), F.lit("\nHS CODE: "), key(6, "8"), F.lit(" / 392410\nFREIGHT "), F.when(F.col("o_orderstatus") == "F", "PREPAID").otherwise("COLLECT"),
            F.lit("\nMSCU"), key(7, "1"), F.lit(" SEAL: SL"), key(5, "0"), F.lit(" 40'HC\n12 PALLETS GROSS WEIGHT: 1,250.50 KGS VOLUME: 33.250 CBM\nDATE OF ISSUE: "), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")),
        ).alias("text"),
    )


@query("""
SELECT o_orderkey, 'ORD' || lpad(o_orderkey::VARCHAR, 8, '0') AS number, 'HS' || o_custkey || '9000' AS child, lpad(o_orderkey::VARCHAR, 19, '7') AS customs, CASE WHEN lpad(o_orderkey::VARCHAR, 6, '8') = '392410' THEN '392410' ELSE lpad(o_orderkey::VARCHAR, 6, '8') || '|392410' END AS tariff,
  'V' || o_custkey || 'W' AS voyage, 'SHANGHAI' AS origin, 'PORT SAID' AS destination, 'MSCU' || lpad(o_orderkey::VARCHAR, 7, '1') AS container, 'SL' || lpad(o_orderkey::VARCHAR, 5, '0') AS seal, '40HC' AS kind, 12.0::DOUBLE AS packages, 1250.5::DOUBLE AS gross, 33.25::DOUBLE AS volume FROM orders""")
def bill_fields(spark, sf_dir):
    """[RGX-01 to RGX-05, RGX-11] Numbers, codes, containers, route and measures of bills."""
    t = F.col("text")
    origin, destination = fields.route(t, ["Shanghai", "Port Said", "Said"])
    box, m = F.col("box"), F.col("m")
    found = computed(bills(spark, sf_dir), {"box": F.get(fields.containers(t), F.lit(0)), "m": fields.measures(t)}).select(
        "o_orderkey", fields.document_number(t).alias("number"), fields.child_number(t).alias("child"), fields.customs_id(t).alias("customs"), fields.tariff_codes(t).alias("tariff"), fields.voyage(t).alias("voyage"),
        origin.alias("origin"), destination.alias("destination"), F.regexp_replace(box["number"], "-", "").alias("container"), box["seal"].alias("seal"), box["type"].alias("kind"), m["packages"].alias("packages"), m["gross_kg"].alias("gross"), m["volume_cbm"].alias("volume"),
    )
    return found


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'IST' || lpad(o_orderkey::VARCHAR, 9, '0') WHEN 1 THEN substr((o_orderkey % 900 + 100)::VARCHAR, 1, 2) || ' ' || (o_orderkey % 900 + 100)::VARCHAR WHEN 2 THEN lpad(o_orderkey::VARCHAR, 10, '2') END AS number FROM orders""")
def page_header_numbers(spark, sf_dir):
    """[RGX-06] Numbers that page headers state: a carrier's, one glued to a street line, one below the labels, or none."""
    k, o = F.col("o_orderkey") % 4, F.col("o_orderkey")
    three = (o % 900 + 100).cast("string")
    page = (
        F.when(k == 0, F.concat(F.lit("page ist"), F.lpad(o.cast("string"), 9, "0"), F.lit(" text")))
        .when(k == 1, F.concat(F.lit("Shipper B/L No\nACME AB\nMAIN ROAD 1 "), F.substring(three, 1, 2), F.lit(" "), three, F.lit("\n684 22 TOWN")))
        .when(k == 2, F.concat(F.lit("SHIPPER EXPORTER  BILL OF LADING NO.\nAcme Ltd "), F.lpad(o.cast("string"), 10, "2"), F.lit("\nfmc organization no. 12345")))
        .otherwise(F.concat(F.lit("SHIPPER BILL OF LADING NO.\nAcme "), F.lpad(o.cast("string"), 5, "0")))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", fields.page_number_id(page).alias("number"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 2 THEN lpad((l_partkey % 10000)::VARCHAR, 4, '1') END AS un, CASE WHEN l_linenumber % 3 <> 1 THEN '3.1' END AS class, CASE WHEN l_linenumber % 3 = 0 THEN '23.5 C' END AS flash, (l_linenumber % 3 = 0) AS pollutant FROM lineitem WHERE l_linenumber % 3 <> 2 OR l_linenumber % 2 = 0""")
def hazards(spark, sf_dir):
    """[RGX-07] Dangerous goods named in texts; a class alone counts in context only."""
    k = F.col("l_linenumber") % 3
    un = F.concat(F.lit("UN No. "), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "1"))
    said = F.when(k == 0, F.concat(un, F.lit(" class 3.1, flash point: 23.5 C, marine pollutant: yes"))).when(k == 1, un).otherwise(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "IMO ").otherwise(""), F.lit("class 3.1")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fields.hazard(said).alias("h")).where("h is not null").select("l_orderkey", "l_linenumber", F.col("h.un_number").alias("un"), F.col("h.hazard_class").alias("class"), F.col("h.flash_point").alias("flash"), F.col("h.pollutant").alias("pollutant"))


@query("""
SELECT p_partkey, p_name AS product, CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS packing, '64-17-' || p_partkey % 10 AS cas, lpad(p_partkey::VARCHAR, 9, '4') AS reference FROM part""")
def safety_sheets(spark, sf_dir):
    """[RGX-08] Safety data sheets."""
    group = F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("III")), (F.col("p_partkey") % 3 + 1).cast("int"))
    sheet = F.concat(F.lit("Product name: "), "p_name", F.lit("\nPacking group: "), group, F.lit("\nCAS 64-17-"), (F.col("p_partkey") % 10).cast("string"))
    found = fields.safety_sheet(sheet, F.concat(F.lit("msds_123456_"), F.lpad(F.col("p_partkey").cast("string"), 9, "4"), F.lit(".pdf")))
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("s")).select("p_partkey", F.col("s.product").alias("product"), F.col("s.packing_group").alias("packing"), F.col("s.cas_number").alias("cas"), F.col("s.reference").alias("reference"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN (props::JSON ->> '$.k')::BIGINT END AS k FROM events")
def json_in_texts(spark, sf_dir):
    """[RGX-26] JSON objects in fences, between words, and broken."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("here:\n```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).when(k == 2, F.col("props")).otherwise(F.concat(F.lit("{"), "props"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(fields.json_object(said), "$.k").try_cast("long").alias("k"))
