"""Named queries over the harness tables, each with the SQL that must give the same rows.

The tables hold few French identifiers, so most queries build their text from table keys with an expression that Spark and
the checking SQL share; what must be found is then known from the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import keys, text, values
from veilwork.operators import codes, evaluation, fusion, model, references, reinjection, review, rules
from veilwork.plans import pipeline
from veilwork.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", spread=name != "lineitem")


# -- check keys -----------------------------------------------------------------------------------------------------
_LUHN = "(list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INT) ELSE (CAST(d[len(d) - i] AS INT) * 2) // 10 + (CAST(d[len(d) - i] AS INT) * 2) % 10 END)) % 10 = 0)"
_LUHN_OF = _LUHN.replace("d[", "{d}[").replace("len(d)", "len({d})")


@_query(f"SELECT k, len(d) >= 2 AND {_LUHN} AS valid FROM (SELECT o_orderkey AS k, concat(o_orderkey) AS d FROM orders)")
def luhn_orders(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", keys.luhn(F.concat(F.lit("n "), F.col("k").cast("string"))).alias("valid"))


_SIREN = "lpad(concat(k * 7919 % 1000000000), 9, '0')"
_SIRET = "concat(CASE WHEN k % 2 = 0 THEN '356000000' ELSE lpad(concat(k * 7919 % 1000000000), 9, '0') END, lpad(concat(k % 100000), 5, '0'))"


@_query(
    f"""SELECT k, {_LUHN_OF.format(d="a")} AS siren, CASE WHEN k % 2 = 0 THEN list_sum(list_transform(range(1, 15), lambda i: CAST(b[i] AS INT))) % 5 = 0
    ELSE {_LUHN_OF.format(d="b")} END AS siret, {_LUHN_OF.format(d="c")} AS card
    FROM (SELECT k, {_SIREN} AS a, {_SIRET} AS b, concat('4970', lpad(concat(k), 12, '0')) AS c FROM (SELECT o_orderkey AS k FROM orders))"""
)
def siren_siret_card_orders(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    card = F.regexp_replace(F.expr("concat('4970', lpad(concat(k), 12, '0'))"), "(.{4})", "$1 ")
    return o.select("k", keys.siren(F.expr(_SIREN)).alias("siren"), keys.siret(F.expr(_SIRET)).alias("siret"), keys.card(card).alias("card"))


_IBAN = "concat('ZZ', lpad(concat(k % 100), 2, '0'), lpad(concat(k * 104729), 20, '0'))"


@_query("SELECT k, CAST(concat(lpad(concat(k * 104729), 20, '0'), '3535', lpad(concat(k % 100), 2, '0')) AS HUGEINT) % 97 = 1 AS valid FROM (SELECT o_orderkey AS k FROM orders)")
def iban_orders(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", keys.iban(F.regexp_replace(F.expr(_IBAN), "(.{4})", "$1 ")).alias("valid"))


_NIR = "concat('2', lpad(concat(k % 100), 2, '0'), '05', CASE WHEN k % 3 = 0 THEN '2A' WHEN k % 3 = 1 THEN '2B' ELSE '99' END, lpad(concat(k % 1000000), 6, '0'))"


@_query(
    f"""SELECT k, k % 5 <> 0 AS valid, true AS shape FROM (SELECT o_orderkey AS k FROM orders)"""
)
def nir_orders(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).withColumn("body", F.expr(_NIR))
    number = F.expr("CAST(concat(substring(body, 1, 5), CASE substring(body, 6, 2) WHEN '2A' THEN '19' WHEN '2B' THEN '18' ELSE '99' END, substring(body, 8, 6)) AS BIGINT)")
    key = F.when(F.col("k") % 5 == 0, (97 - number % 97) % 97 + 1).otherwise(97 - number % 97)
    key = F.when((F.col("k") % 5 == 0) & (key == 97 - number % 97), key - 1).otherwise(key)
    value = F.concat("body", F.lit(" "), F.lpad(key.cast("string"), 2, "0"))
    return o.select("k", keys.nir(value).alias("valid"), value.rlike("^[0-9]{5}..[0-9]{6} [0-9]{2}$").alias("shape"))


@_query("SELECT k, k % 300 <= 255 AND k % 1200 <> 7 AS valid FROM (SELECT o_orderkey AS k FROM orders)")
def ip_orders(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", keys.ip(F.expr("concat('192.0.', k % 300, CASE WHEN k % 1200 = 7 THEN '.1.2' ELSE '.007' END)")).alias("valid"))


# -- scans of the supplied texts ------------------------------------------------------------------------------------
_MAIL_SQL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"


def _mails(df: DataFrame, key: str, doc: str) -> DataFrame:
    found = text.hold(df.select(key, doc), _s=rules.RULES[0].scan(F.col(doc))).select(key, F.explode("_s").alias("s"))
    return found.groupBy(key, F.col("s.text").alias("value")).agg(F.count("*").alias("n"))


@_query(f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL_SQL}')) AS value FROM documents) GROUP BY doc_id, value")
def scan_email(spark, sf):
    return _mails(_table(spark, sf, "documents"), "doc_id", "text")


@_query(f"SELECT page_id, value, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_MAIL_SQL}')) AS value FROM pages) GROUP BY page_id, value")
def scan_email_pages(spark, sf):
    return _mails(_table(spark, sf, "pages"), "page_id", "html")


@_query(
    f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_MAIL_SQL}') AS m, regexp_split_to_array(text, '{_MAIL_SQL}') AS p FROM documents WHERE text LIKE '%@%'),
    u AS (SELECT *, list_transform(m, lambda x: lower(x)) AS k FROM d),
    v AS (SELECT *, list_transform(k, lambda x: concat('[EMAIL_', lpad(concat(len(list_distinct(k[1:list_position(k, x)]))), 3, '0'), ']')) AS c FROM u)
    SELECT doc_id, CAST(len(m) AS INTEGER) AS n_masked, array_to_string(list_transform(range(1, len(p) + 1), lambda i: concat(p[i], coalesce(c[i], ''))), '') AS masked_text FROM v WHERE len(m) > 0"""
)
def mask_emails(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text").where(F.contains("text", F.lit("@")))
    docs = codes.assign(text.hold(docs, spans=fusion.fuse(rules.RULES[0].scan(F.col("text")))), names=False).where(F.size("spans") > 0)
    return docs.select("doc_id", F.size("spans").alias("n_masked"), codes.rewrite(F.col("text"), F.col("spans"), F.col("codes")).alias("masked_text"))


@_query(None)
def mask_documents(spark, sf):
    """The whole rule analysis of every document. Its parts have queries with SQL; letters, cases and keyed scans check them together."""
    done = pipeline.pseudonymise(_table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("spans").alias("n_masked"), F.size("flags").alias("n_flagged"), "masked_text")


@_query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, true AS whole, true AS short FROM documents")
def chunk_documents(spark, sf):
    docs = model.chunk(_table(spark, sf, "documents").select("doc_id", "text"))
    joined = F.array_join(F.transform("fragments", lambda f: f["text"]), "")
    placed = F.forall("fragments", lambda f: F.substring(F.col("text"), f["offset"] + 1, F.length(f["text"])) == f["text"])
    most = F.array_max(F.transform("fragments", lambda f: F.length(f["text"])))
    return docs.select("doc_id", F.length("text").alias("n_chars"), ((joined == F.col("text")) & placed).alias("whole"), (most <= values.FRAGMENT).alias("short"))


# -- letters built from customer keys -------------------------------------------------------------------------------
_PARTS = {
    "ref": "concat(10000 + k)",
    "street": "concat(k % 200 + 1, ' rue de l', chr(39), 'Exemple, 00100 Nullepart')",
    "mail": "concat('client', k, '@example.org')",
    "phone": "concat('06 39 98 ', lpad(concat(k % 100), 2, '0'), ' ', lpad(concat(k % 90 + 10), 2, '0'))",
    "birth": "concat('0', k % 9 + 1, '/05/1980')",
    "ip": "concat('192.0.2.', k % 250)",
    "plate": "concat('AA-', lpad(concat(k % 1000), 3, '0'), '-BB')",
    "typed": "concat('AB12-2026-', lpad(concat(k % 10000), 4, '0'))",
    "bare": "concat(7000000 + k)",
}
_LETTER = """concat('Dossier n° ', {ref}, '.', chr(10), 'Adresse : ', {street}, '.', chr(10), 'Courriel ', {mail}, ', tel. ', {phone}, ', né le ', {birth},
    ', IP ', {ip}, ', plaque ', {plate}, '. SIRET 120 027 016 00563, carte 4242 4242 4242 4242. Vu ', {typed}, ' et la serie ', {bare}, ' enfin. Ecrire à ', {mail}, '.')""".format(**_PARTS)
_SPANS = [("IDENTIFIANT", "ref"), ("ADRESSE", "street"), ("EMAIL", "mail"), ("TELEPHONE", "phone"), ("DATE_NAISSANCE", "birth"), ("IP", "ip"), ("PLAQUE", "plate"), ("IDENTIFIANT", "typed")]
_MASKED = (
    "concat('Dossier n° [IDENTIFIANT_001].', chr(10), 'Adresse : [ADRESSE_001].', chr(10), 'Courriel [EMAIL_001], tel. [TELEPHONE_001], né le [DATE_NAISSANCE_001], "
    "IP [IP_001], plaque [PLAQUE_001]. SIRET [SIRET_001], carte [CARTE_BANCAIRE_001]. Vu [IDENTIFIANT_002] et la serie ', 7000000 + k, ' enfin. Ecrire à [EMAIL_001].')"
)
_L = f"l AS (SELECT c_custkey AS k, {_LETTER} AS t FROM (SELECT c_custkey, c_custkey AS k FROM customer))"
_FIXED = [("SIRET", "'120 027 016 00563'"), ("CARTE_BANCAIRE", "'4242 4242 4242 4242'")]
_ROWS = " UNION ALL ".join(f"SELECT k, t, '{c}' AS category, {e} AS value FROM l" for c, e in [*((c, _PARTS[p]) for c, p in _SPANS), *_FIXED])


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return c.select(F.col("k").alias("doc_id"), F.expr(_LETTER).alias("text"))


@_query(
    f"""WITH {_L}, r AS ({_ROWS})
    SELECT k AS doc_id, CAST(strpos(t, value) - 1 AS INTEGER) AS start, CAST(strpos(t, value) - 1 + length(value) AS INTEGER) AS "end", category, value AS text, 'regle' AS source FROM r
    UNION ALL SELECT k, CAST(length(t) - 1 - length({_PARTS["mail"]}) AS INTEGER), CAST(length(t) - 1 AS INTEGER), 'EMAIL', {_PARTS["mail"]}, 'regle' FROM l
    UNION ALL SELECT k, CAST(strpos(t, concat('serie ', 7000000 + k)) + 5 AS INTEGER), CAST(strpos(t, concat('serie ', 7000000 + k)) + 12 AS INTEGER), 'IDENTIFIANT', concat(7000000 + k), 'signalement' FROM l"""
)
def analyse_letters(spark, sf):
    done = pipeline.analyse(_letters(spark, sf))
    return done.select("doc_id", F.inline(F.concat("spans", "flags"))).drop("score")


@_query(f"WITH {_L} SELECT k AS doc_id, {_MASKED} AS masked_text FROM l")
def mask_letters(spark, sf):
    return pipeline.pseudonymise(_letters(spark, sf)).select("doc_id", "masked_text")


_CODES = [("[IDENTIFIANT_001]", "ref"), ("[ADRESSE_001]", "street"), ("[EMAIL_001]", "mail"), ("[TELEPHONE_001]", "phone"), ("[DATE_NAISSANCE_001]", "birth"), ("[IP_001]", "ip"), ("[PLAQUE_001]", "plate"), ("[IDENTIFIANT_002]", "typed")]
_CODE_ROWS = " UNION ALL ".join(f"SELECT k, '{c}' AS code, {e} AS value FROM l" for c, e in [*((c, _PARTS[p]) for c, p in _CODES), ("[SIRET_001]", _FIXED[0][1]), ("[CARTE_BANCAIRE_001]", _FIXED[1][1])])


@_query(f"WITH {_L}, r AS ({_CODE_ROWS}) SELECT k AS doc_id, code, regexp_extract(code, '[A-Z_]+[A-Z]') AS category, CAST(1 AS INTEGER) AS n_values, value AS canonical FROM r")
def code_table(spark, sf):
    rows = codes.table_rows(pipeline.pseudonymise(_letters(spark, sf)))
    return rows.select("doc_id", "code", "category", F.size("values").alias("n_values"), "canonical")


@_query("SELECT category, CAST(n * (SELECT count(*) FROM customer) AS BIGINT) AS n FROM (VALUES ('IDENTIFIANT', 2), ('ADRESSE', 1), ('EMAIL', 2), ('TELEPHONE', 1), ('DATE_NAISSANCE', 1), ('IP', 1), ('PLAQUE', 1), ('SIRET', 1), ('CARTE_BANCAIRE', 1), ('(flags)', 1)) v(category, n)")
def category_counts(spark, sf):
    return pipeline.counts(pipeline.analyse(_letters(spark, sf)))


@_query(f"WITH {_L} SELECT k AS doc_id, t AS restored, CAST(11 AS INTEGER) AS n_replaced, CAST(0 AS INTEGER) AS n_anomalies, true AS no_problem FROM l")
def reinject_roundtrip(spark, sf):
    done = pipeline.pseudonymise(_letters(spark, sf)).select("doc_id", F.col("masked_text").alias("reply"), "code_table")
    return reinjection.reinject(done).select("doc_id", "restored", "n_replaced", F.size("anomalies").alias("n_anomalies"), "no_problem")


_REPLY = "concat('Bonjour [email 1], votre [Identifiant-002] et [IP_001]; [PERSONNE_', k % 7 + 1, '] inconnu.')"


@_query(
    f"""WITH {_L}, a AS (
      SELECT k, '[email 1]' AS found, '{values.REPAIRED_CODE}' AS reason, '[EMAIL_001]' AS resolved, 'verifier' AS severity FROM l
      UNION ALL SELECT k, '[Identifiant-002]', '{values.REPAIRED_CODE}', '[IDENTIFIANT_002]', 'verifier' FROM l
      UNION ALL SELECT k, concat('[PERSONNE_', k % 7 + 1, ']'), '{values.UNKNOWN_CODE}', NULL, 'verifier' FROM l
      UNION ALL SELECT k, code, '{values.UNMENTIONED_CODE.replace(chr(39), chr(39) * 2)}', NULL, 'information' FROM l, (VALUES {", ".join(f"('{c}')" for c, _ in _CODES if c != "[IP_001]")}, ('[SIRET_001]'), ('[CARTE_BANCAIRE_001]')) v(code))
    SELECT k AS doc_id, found, reason, resolved, severity, concat('Bonjour ', {_PARTS["mail"]}, ', votre ', {_PARTS["typed"]}, ' et ', {_PARTS["ip"]}, '; [PERSONNE_', k % 7 + 1, '] inconnu.') AS restored FROM a"""
)
def reinject_damaged(spark, sf):
    done = pipeline.pseudonymise(_letters(spark, sf)).withColumn("k", F.col("doc_id")).withColumn("reply", F.expr(_REPLY))
    out = reinjection.reinject(done)
    return out.select("doc_id", "restored", F.inline("anomalies"))


@_query(f"WITH {_L}, r AS ({_CODE_ROWS}) SELECT k AS doc_id, code, value FROM r")
def table_json(spark, sf):
    done = pipeline.pseudonymise(_letters(spark, sf)).select("doc_id", codes.to_json(F.col("code_table"), F.lit("2026-01-01T00:00:00+00:00")).alias("j"))
    back = text.hold(done, code_table=codes.from_json(F.col("j")))
    return codes.table_rows(back).select("doc_id", "code", F.col("canonical").alias("value"))


@_query("SELECT c_custkey AS doc_id, category, CAST(n AS INTEGER) AS last FROM customer, (VALUES ('EMAIL', 8), ('IP', 1)) v(category, n)")
def numbering_goes_on(spark, sf):
    """A second text of the case goes on from the stored table, whose mail is known again whatever its case."""
    earlier = F.array(F.struct(F.lit("[EMAIL_007]").alias("code"), F.lit("EMAIL").alias("category"), F.array(F.lit("vieux@example.org")).alias("values")))
    docs = _table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("concat('De VIEUX@example.org à neuf', c_custkey, '@example.org, 192.0.2.1')").alias("text"), earlier.alias("earlier"))
    done = pipeline.mask(pipeline.analyse(docs), earlier_col="earlier")
    return codes.last_numbers(codes.table_rows(done))


# -- overlaps, addresses, references --------------------------------------------------------------------------------
@_query(
    """WITH RECURSIVE s AS (
      SELECT l_orderkey AS k, CAST(l_partkey % 40 AS INTEGER) AS a, CAST(l_partkey % 40 + l_quantity AS INTEGER) AS b,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_partkey % 40 + l_quantity AS INTEGER) - CAST(l_partkey % 40 AS INTEGER) DESC,
          CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'N' THEN 2 ELSE 1 END DESC, l_discount DESC, l_partkey % 40, l_linenumber, l_partkey, l_suppkey) AS n
      FROM lineitem),
    r AS (
      SELECT k, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a INTEGER, b INTEGER)[]) AS kept FROM s GROUP BY k
      UNION ALL
      SELECT r.k, s.n, CASE WHEN len(list_filter(r.kept, lambda x: x.a < s.b AND s.a < x.b)) = 0 THEN list_append(r.kept, {'a': s.a, 'b': s.b}) ELSE r.kept END
      FROM r JOIN s ON r.k = s.k AND s.n = r.n + 1),
    z AS (SELECT k, unnest(arg_max(kept, n)) AS x FROM r GROUP BY k)
    SELECT k AS doc_id, x.a AS start, x.b AS "end" FROM z"""
)
def fuse_lineitem(spark, sf):
    li = _table(spark, sf, "lineitem")
    start = (F.col("l_partkey") % 40).cast("int")
    source = F.when(F.col("l_returnflag") == "A", values.RULE).when(F.col("l_returnflag") == "N", values.PROPAGATED).otherwise(values.MODEL)
    one = F.struct(start.alias("start"), (F.col("l_partkey") % 40 + F.col("l_quantity")).cast("int").alias("end"), F.lit("X").alias("category"), F.lit("").alias("text"), source.alias("source"), F.col("l_discount").alias("score"))
    order = F.struct(F.col("l_linenumber"), "l_partkey", "l_suppkey", one.alias("s"))
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(order)).alias("o"))
    docs = text.hold(docs, spans=fusion.fuse(F.transform("o", lambda x: x["s"]).cast(text.SPANS)))
    return docs.select("doc_id", F.inline("spans")).select("doc_id", "start", "end")


_ADDRESS = """concat('Envoi : ', CASE k % 4 WHEN 0 THEN concat('Bâtiment B, ', k % 300 + 1, ' bis avenue du Général-Exemple', chr(10), '00100 Nullepart Cedex ', k % 9 + 1)
    WHEN 1 THEN concat('00', 100 + k % 900, ' Saint-Exemple') WHEN 2 THEN concat('2e étage, salle ', k % 9, ', rue barrée') ELSE concat('place de l', chr(39), 'Exemple, BP ', k % 100) END, ' - merci.')"""


@_query(
    f"""SELECT k AS doc_id, CASE k % 4 WHEN 1 THEN 'CODE_POSTAL_VILLE' ELSE 'ADRESSE' END AS category, CASE k % 4 WHEN 0 THEN substring(t, 9, strpos(t, ' - merci') - 9) WHEN 1 THEN substring(t, 9, strpos(t, ' - merci') - 9) ELSE substring(t, 9, strpos(t, ' - merci') - 9) END AS text
    FROM (SELECT k, {_ADDRESS} AS t FROM (SELECT s_suppkey AS k FROM supplier)) WHERE k % 4 <> 2"""
)
def address_blocks(spark, sf):
    docs = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).select(F.col("k").alias("doc_id"), F.expr(_ADDRESS).alias("text"))
    return pipeline.analyse(docs).select("doc_id", F.inline("spans")).select("doc_id", "category", "text")


_REFERENCE = """CASE k % 8 WHEN 0 THEN concat('Votre dossier n°', 4000 + k, ' est clos') WHEN 1 THEN concat('Réf. : QX-', 1000 + k, ' à citer') WHEN 2 THEN concat('Facture de ', 1000 + k, ' € payée')
    WHEN 3 THEN concat('Décret n° 2024-', 1000 + k, ' cité') WHEN 4 THEN concat('Suivi PRJ/2025/', 1000 + k, '-B ici') WHEN 5 THEN concat('Voir ', 7000000 + k, ', merci')
    WHEN 6 THEN concat('Demande du 14/07/2026. ', 7000000 + k) ELSE concat('Client numéro ', k % 9 + 1, ' 234 ', lpad(concat(k % 1000), 3, '0'), ' reçu') END"""


@_query(
    f"""WITH o AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS doc_id, CASE k % 8 WHEN 0 THEN concat(4000 + k) WHEN 1 THEN concat('QX-', 1000 + k) WHEN 4 THEN concat('PRJ/2025/', 1000 + k, '-B') WHEN 7 THEN concat(k % 9 + 1, ' 234 ', lpad(concat(k % 1000), 3, '0')) ELSE concat(7000000 + k) END AS value,
    k % 8 IN (5, 6) AS flagged FROM o WHERE k % 8 NOT IN (2, 3)"""
)
def references_orders(spark, sf):
    docs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("doc_id"), F.expr(_REFERENCE).alias("text"))
    done = pipeline.analyse(docs).select("doc_id", F.inline(F.concat("spans", "flags")))
    return done.select("doc_id", F.col("text").alias("value"), (F.col("source") == values.FLAG).alias("flagged"))


@_query("SELECT o_orderkey AS doc_id, o_orderkey % 2 = 1 AS kept FROM orders")
def references_public(spark, sf):
    """Numbers right behind a law or order go, whatever found them; elsewhere in the sentence they stay."""
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    docs = o.select(F.col("k").alias("doc_id"), F.expr("CASE WHEN k % 2 = 0 THEN concat('Selon l', chr(39), 'arrêté nº ', 10000 + k, ' ici') ELSE concat('Arrêté cité, dossier ', 10000 + k) END").alias("text"))
    docs = text.hold(docs, found=references.announced(F.col("text")))
    docs = text.hold(docs, s=references.drop_public(F.col("text"), F.col("found")))
    return docs.select("doc_id", (F.size("s") > 0).alias("kept"))


# -- names ----------------------------------------------------------------------------------------------------------
_PERSON = "concat('Zoé Fictif', k)"
_NAMES = f"concat('Note. ', {_PERSON}, ' a vu Mme Fictif', k, ' et Z. Fictif', k, '. Marc Marchand dit que Zoé part. Fictif', k, 'a reste.')"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    docs = c.select(F.col("k").alias("doc_id"), F.expr(_NAMES).alias("text"), F.expr(_PERSON).alias("p"))
    doc, p = F.col("text"), F.col("p")
    spans = F.array(text.span(doc, F.lit(6), 6 + F.length(p), "PERSONNE", values.MODEL, F.lit(0.9)), text.span(doc, F.instr(doc, F.lit("Marc Marchand")) - 1, F.instr(doc, F.lit("Marc Marchand")) + 12, "PERSONNE", values.MODEL, F.lit(0.8)))
    return docs.withColumn("model", spans.cast(text.SPANS)).drop("p")


@_query(
    f"""WITH c AS (SELECT c_custkey AS k, concat('Fictif', c_custkey) AS f FROM customer)
    SELECT k AS doc_id, concat('Note. [PERSONNE_001] a vu Mme [PERSONNE_001] et Z. [PERSONNE_001]. [PERSONNE_002] dit que [PERSONNE_001] part. ', f, 'a reste.') AS masked_text FROM c"""
)
def propagate_names(spark, sf):
    return pipeline.pseudonymise(_named(spark, sf), model_col="model").select("doc_id", "masked_text")


@_query("SELECT c_custkey AS doc_id, code, CAST(n AS INTEGER) AS n_values FROM customer, (VALUES ('[PERSONNE_001]', 3), ('[PERSONNE_002]', 1)) v(code, n)")
def fuzzy_codes(spark, sf):
    rows = codes.table_rows(pipeline.pseudonymise(_named(spark, sf), model_col="model"))
    return rows.select("doc_id", "code", F.size("values").alias("n_values"))


@_query("SELECT c_custkey AS doc_id, CAST(6 AS INTEGER) AS start, 'PERSONNE' AS category FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 6, 'ORGANISATION' FROM customer WHERE c_custkey % 4 = 1")
def model_accept(spark, sf):
    """Predictions that are unsure, misplaced, of an unknown label or implausible are dropped."""
    c = _table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    docs = c.withColumn("text", F.when(F.col("doc_id") % 4 == 3, "Note. mairie de nuit").otherwise("Note. Mairie de nuit"))
    label = F.when(F.col("doc_id") % 4 == 0, "person").when(F.col("doc_id") % 4 == 2, "animal").otherwise("organization")
    shown = F.when(F.col("doc_id") % 4 == 3, "mairie").otherwise("Mairie")
    p = docs.select("doc_id", F.lit(6).alias("start"), F.lit(12).alias("end"), label.alias("label"), shown.alias("text"), F.lit(0.7).alias("score"))
    p = p.unionByName(p.withColumn("score", F.lit(0.1)).withColumn("label", F.lit("person"))).unionByName(p.withColumn("start", F.lit(5)).withColumn("end", F.lit(11)).withColumn("label", F.lit("person")))
    return model.accept(docs, p).select("doc_id", F.inline("spans")).select("doc_id", "start", "category")


# -- review ---------------------------------------------------------------------------------------------------------
@_query(
    f"""WITH {_L} SELECT k AS doc_id, concat('EMAIL · « ', {_PARTS["mail"]}, ' » — format reconnu (position ', strpos(t, {_PARTS["mail"]}) - 1, ')') AS first_mail,
    concat('IDENTIFIANT · « ', 7000000 + k, ' » — à trancher (position ', strpos(t, concat('serie ', 7000000 + k)) + 5, ')') AS flag, CAST(11 AS INTEGER) AS n_checked, CAST(1 AS INTEGER) AS n_flagged FROM l"""
)
def review_labels(spark, sf):
    r = review.to_review(pipeline.analyse(_letters(spark, sf)))
    mail = F.get(F.filter("review", lambda x: x["span"]["category"] == "EMAIL"), 0)["label"]
    flag = F.get(F.filter("review", lambda x: ~x["checked"]), 0)["label"]
    return r.select("doc_id", mail.alias("first_mail"), flag.alias("flag"), "n_checked", "n_flagged")


@_query("SELECT c_custkey AS doc_id, CAST(2 AS BIGINT) AS n_kept, CAST(10 AS BIGINT) AS n_rejected, concat('serie [IDENTIFIANT_001] enfin') AS seen FROM customer WHERE c_custkey % 2 = 0")
def review_keep(spark, sf):
    """Half of the cases keep the plate and the flagged series; the rest of their spans count as rejected.

    The other half is reviewed, too, but has no decision: it keeps nothing and so produces no row.
    """
    r = review.to_review(pipeline.analyse(_letters(spark, sf)))
    chosen = r.select("doc_id", F.explode("review").alias("r")).where((F.col("r.span.category") == "PLAQUE") | ~F.col("r.checked"))
    kept = review.keep(r, chosen.where("doc_id % 2 = 0").select("doc_id", F.col("r.label").alias("label")))
    done = review.produce(r.select("doc_id", "text"), kept)
    return done.select("doc_id", "n_kept", "n_rejected", F.regexp_extract("masked_text", "serie .* enfin", 0).alias("seen"))


@_query(f"SELECT k AS doc_id, CAST(2 AS INTEGER) AS n_added, replace({_NAMES}, 'Marchand dit que Zoé', '[ORGANISATION_001] dit que Zoé') AS masked_text FROM (SELECT c_custkey AS k FROM customer) WHERE false UNION ALL SELECT c_custkey, CAST(1 AS INTEGER), concat('Note. Zoé Fictif', c_custkey, ' a vu Mme Fictif', c_custkey, ' et Z. Fictif', c_custkey, '. Marc [PERSONNE_001] dit que Zoé part. Fictif', c_custkey, 'a reste.') FROM customer")
def review_add(spark, sf):
    docs = _named(spark, sf).drop("model").withColumn("spans", text.none()).withColumn("w", F.lit(" Marchand ")).withColumn("c", F.lit("PERSONNE"))
    done = codes.assign(review.add(docs, "w", "c"))
    return done.select("doc_id", "n_added", codes.rewrite(F.col("text"), F.col("spans"), F.col("codes")).alias("masked_text"))


@_query(f"WITH {_L} SELECT k AS doc_id, CAST(23 AS INTEGER) AS n_segments, CAST(11 AS INTEGER) AS n_coloured, true AS whole FROM l")
def highlight_segments(spark, sf):
    d = text.hold(pipeline.analyse(_letters(spark, sf)), g=review.segments(F.col("text"), F.col("spans")))
    whole = F.array_join(F.transform("g", lambda x: x["text"]), "") == F.col("text")
    return d.select("doc_id", F.size("g").alias("n_segments"), F.size(F.filter("g", lambda x: x["category"].isNotNull())).alias("n_coloured"), whole.alias("whole"))


@_query(f"WITH {_L} SELECT k AS doc_id, true AS same FROM l")
def serialise_spans(spark, sf):
    d = pipeline.analyse(_letters(spark, sf))
    return d.select("doc_id", (review.deserialise(review.serialise(F.col("spans"))) == F.col("spans")).alias("same"))


# -- evaluation -----------------------------------------------------------------------------------------------------
def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Letters with expected spans: the mail twice, the phone, a person that nothing finds, and half an address."""
    df = _letters(spark, sf).withColumn("k", F.col("doc_id"))
    directs = F.create_map(
        F.lit("EMAIL"), F.array(F.expr(_PARTS["mail"])), F.lit("TELEPHONE"), F.array(F.expr(_PARTS["phone"])), F.lit("PERSONNE"), F.array(F.lit("Courriel")), F.lit("LIEU"), F.array(F.lit("Nullepart")),
    )
    return pipeline.analyse(text.hold(df, expected=evaluation.expected(F.col("text"), directs)))


@_query(
    """WITH n AS (SELECT count(*) AS n FROM customer), v(category, e, m, t, w, p, a) AS (VALUES ('EMAIL', 2, 2, 2, 2, 2, 0), ('TELEPHONE', 1, 1, 1, 1, 1, 0), ('PERSONNE', 1, 0, 0, 0, 0, 0), ('LIEU', 1, 1, 0, 1, 0, 0), ('ADRESSE', 0, 0, 0, 0, 1, 0),
      ('IDENTIFIANT', 0, 0, 0, 0, 2, 2), ('DATE_NAISSANCE', 0, 0, 0, 0, 1, 1), ('IP', 0, 0, 0, 0, 1, 1), ('PLAQUE', 0, 0, 0, 0, 1, 1), ('SIRET', 0, 0, 0, 0, 1, 1), ('CARTE_BANCAIRE', 0, 0, 0, 0, 1, 1), (NULL, 5, 4, 3, 4, 11, 7))
    SELECT category, e * n AS expected, m * n AS masked, t * n AS typed, w * n AS whole, p * n AS predicted, a * n AS false_alarms, round(m / nullif(e, 0), 6) AS recall, round(1 - a / nullif(p, 0), 6) AS precision FROM v, n"""
)
def evaluation_report(spark, sf):
    d = _scored(spark, sf)
    r = evaluation.report(evaluation.score_expected(d), evaluation.score_predicted(d))
    return r.select("category", "expected", "masked", "typed", "whole", "predicted", "false_alarms", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@_query("SELECT criterion, target, CAST(e * (SELECT count(*) FROM customer) AS BIGINT) AS expected, CAST(m * (SELECT count(*) FROM customer) AS BIGINT) AS masked, met FROM (VALUES ('identifiants a format fixe', 1.0::DOUBLE, 3, 3, true), ('noms de personnes', 0.9::DOUBLE, 1, 0, false)) v(criterion, target, e, m, met)")
def evaluation_criteria(spark, sf):
    return evaluation.criteria(evaluation.score_expected(_scored(spark, sf))).select("criterion", "target", "expected", "masked", "met")


@_query("SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey, l_suppkey, round(least(greatest(least(l_quantity, 30) - 10, 0) + least(greatest(l_quantity - 35, 0), 5), 25) / 40, 6) AS coverage FROM lineitem")
def coverage_lineitem(spark, sf):
    """Share of [10, 50) that [10, min(q, 30)) and [35, min(q, 40)) cover; the second span is there twice."""
    q = F.col("l_quantity").cast("int")
    at = lambda a, b: F.struct(F.lit(a).alias("start"), F.greatest(F.least(q, F.lit(b)), F.lit(a)).alias("end"))
    c = evaluation.coverage(F.lit(10), F.lit(50), F.array(at(10, 30), at(35, 40), at(35, 40)))
    return _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.round(c, 6).alias("coverage"))


@_query("SELECT c_custkey AS doc_id, 'la serie' AS phrase, false AS covered FROM customer UNION ALL SELECT c_custkey, 'Exemple, 00100', true FROM customer UNION ALL SELECT c_custkey, 'absent', NULL FROM customer")
def evaluation_indirects(spark, sf):
    d = pipeline.analyse(_letters(spark, sf)).withColumn("indirects", F.array(F.lit("la serie"), F.lit("Exemple, 00100"), F.lit("absent")))
    return evaluation.indirects(d)


@_query(
    """SELECT CASE k % 8 WHEN 2 THEN 'pieges' WHEN 3 THEN 'pieges' ELSE 'cas' END AS "group", CASE WHEN k % 8 IN (5, 6) THEN 'flagged' ELSE 'masked' END AS outcome, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 8 NOT IN (2, 3) GROUP BY ALL"""
)
def evaluation_references(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    phrase = o.select(F.col("k").cast("string").alias("id"), F.expr(_REFERENCE).alias("text"), F.when((F.col("k") % 8).isin(2, 3), "pieges").otherwise("cas").alias("group"), "k")
    wanted = F.expr("CASE k % 8 WHEN 0 THEN concat(4000 + k) WHEN 1 THEN concat('QX-', 1000 + k) WHEN 4 THEN concat('PRJ/2025/', 1000 + k, '-B') WHEN 7 THEN concat(k % 9 + 1, ' 234 ', lpad(concat(k % 1000), 3, '0')) ELSE concat(7000000 + k) END")
    cases = pipeline.analyse(phrase).withColumn("phrase", F.col("text")).withColumn("references", F.when(F.col("group") == "cas", F.array(wanted)).otherwise(F.array().cast("array<string>")))
    return evaluation.references(cases).groupBy("group", "outcome").agg(F.count("*").alias("n"))


@_query("SELECT concat(c_custkey) AS name, CASE WHEN c_custkey % 10 = 0 THEN 'text without truth' ELSE 'annotation not found' END AS problem, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'fantome' END AS value FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 10 = 1 UNION ALL SELECT concat(c_custkey), 'indirect not found', 'nulle part' FROM customer WHERE c_custkey % 10 = 2")
def evaluation_truth(spark, sf):
    texts = _letters(spark, sf).select(F.col("doc_id").cast("string").alias("name"), "text")
    k = F.col("name").cast("long")
    directs = F.create_map(F.lit("IP"), F.array(F.when(k % 10 == 1, "fantome").otherwise("Courriel")))
    truth = texts.where(k % 10 != 0).select("name", directs.alias("directs"), F.array(F.when(k % 10 == 2, "nulle part").otherwise("la serie")).alias("indirects"))
    return evaluation.truth_errors(texts, truth)


@_query(f"WITH {_L} SELECT k AS doc_id, pattern, value FROM (SELECT k, 'ip' AS pattern, {_PARTS['ip']} AS value FROM l UNION ALL SELECT k, 'plaque', {_PARTS['plate']} FROM l UNION ALL SELECT k, 'suite_chiffres', '120 027 016 00563' FROM l UNION ALL SELECT k, 'suite_chiffres', '4242 4242 4242 4242' FROM l)")
def evaluation_unannotated(spark, sf):
    df = _letters(spark, sf).withColumn("k", F.col("doc_id"))
    directs = F.create_map(F.lit("EMAIL"), F.array(F.expr(_PARTS["mail"])), F.lit("TELEPHONE"), F.array(F.expr(_PARTS["phone"])), F.lit("X"), F.array(F.expr(_PARTS["ref"]), F.expr(_PARTS["bare"]), F.lit("2026")))
    return evaluation.unannotated(text.hold(df, expected=evaluation.expected(F.col("text"), directs)))


# -- scans of keyed values, and rules at their edges ----------------------------------------------------------------
_KEYED_IBAN = "concat('ZZ', lpad(concat(98 - (k * 104729 * 1000000 + 353500) % 97 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END), 2, '0'), lpad(concat(k * 104729), 20, '0'))"
_NIR_NUMBER = "(((200 + k % 100) * 100 + 5) * 100000000 + CASE WHEN k % 3 = 0 THEN 19 WHEN k % 3 = 1 THEN 18 ELSE 99 END * 1000000 + k % 1000000)"
_NIR_KEY = f"(97 - {_NIR_NUMBER} % 97)"
_KEYED_NIR = f"concat({_NIR}, ' ', lpad(concat(CASE WHEN k % 5 = 0 THEN {_NIR_KEY} % 97 + 1 ELSE {_NIR_KEY} END), 2, '0'))"
_ABROAD = "concat('+44', repeat(' 7', CAST({n} AS INT)))"
_KEYED = f"concat('Compte ', {_KEYED_IBAN}, '; assurance ', {_KEYED_NIR}, '; entreprise ', {_SIREN}, '; tel ', {_ABROAD.format(n='k % 18')}, ' fin')"


@_query(
    f"""WITH o AS (SELECT k, {_SIREN} AS s FROM (SELECT o_orderkey AS k FROM orders))
    SELECT k AS doc_id, 'IBAN' AS category, {_KEYED_IBAN} AS value FROM o WHERE k % 3 <> 0
    UNION ALL SELECT k, 'NIR', {_KEYED_NIR} FROM o WHERE k % 5 <> 0
    UNION ALL SELECT k, 'SIREN', s FROM o WHERE {_LUHN_OF.format(d="s")}
    UNION ALL SELECT k, 'TELEPHONE', {_ABROAD.format(n="least(k % 18, 14)")} FROM o WHERE k % 18 >= 5"""
)
def scan_keyed_orders(spark, sf):
    """IBAN, NIR, SIREN and numbers abroad within a text: right and wrong keys, too few digits, and more than a number has."""
    docs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("doc_id"), F.expr(_KEYED).alias("text"))
    docs = text.hold(docs, mark=text.mark_for(F.col("text")))
    found = text.hold(docs, s=rules.scan(F.col("text"), F.col("mark"))).select("doc_id", F.explode("s").alias("s"))
    return found.select("doc_id", F.col("s.category").alias("category"), F.col("s.text").alias("value"))


@_query("SELECT s_suppkey AS doc_id, 'ADRESSE' AS category, concat(s_suppkey % 200 + 1, ' rue Exemple, lot ', s_suppkey % 9) AS text, 'regle' AS source FROM supplier WHERE s_suppkey % 2 = 1")
def address_anchors(spark, sf):
    """A model's address goes where no street or postcode anchors it, and joins the block where one does."""
    k = F.col("k")
    docs = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    docs = docs.select("k", F.expr("concat('Lieu : ', CASE WHEN k % 2 = 1 THEN concat(k % 200 + 1, ' rue Exemple, ') ELSE '' END, 'lot ', k % 9, ' - fin')").alias("text"))
    at = F.instr("text", F.lit("lot")) - 1
    docs = docs.select(k.alias("doc_id"), "text", F.array(text.span(F.col("text"), at, at + 5, "ADRESSE", values.MODEL, F.lit(0.9))).cast(text.SPANS).alias("model"))
    done = pipeline.analyse(docs, model_col="model").select("doc_id", F.inline("spans"))
    return done.select("doc_id", "category", "text", "source")


@_query("SELECT o_orderkey AS doc_id, concat(1000 + o_orderkey) AS value FROM orders WHERE o_orderkey % 4 = 3")
def references_ordinals(spark, sf):
    """An ordinal behind a trigger is no reference, whatever its case."""
    docs = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    docs = docs.select(F.col("k").alias("doc_id"), F.expr("concat('Dossier ', 1000 + k, CASE k % 4 WHEN 0 THEN 'e' WHEN 1 THEN 'ème' WHEN 2 THEN 'ER' ELSE '' END, ' cité')").alias("text"))
    return text.hold(docs, s=references.announced(F.col("text"))).select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.text").alias("value"))


@_query("SELECT c_custkey AS doc_id, optional, CASE WHEN optional THEN 'DATE_SENSIBLE' END AS category FROM customer, (VALUES (true), (false)) v(optional)")
def model_optional(spark, sf):
    """The optional label is accepted only where it is asked for."""
    docs = _table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Vu le 3 mai.").alias("text"))
    found = docs.select("doc_id", F.lit(6).alias("start"), F.lit(11).alias("end"), F.lit("sensitive_date").alias("label"), F.lit("3 mai").alias("text"), F.lit(0.9).alias("score"))
    parts = []
    for optional, labels in ((True, values.LABELS | values.OPTIONAL_LABELS), (False, None)):
        got = model.accept(docs, found, labels=labels).select(F.col("doc_id").alias("i"), F.get("spans", F.lit(0))["category"].alias("category"))
        parts.append(docs.join(got, F.col("doc_id") == F.col("i"), "left").select("doc_id", F.lit(optional).alias("optional"), "category"))
    return parts[0].unionByName(parts[1])


@_query("SELECT doc_id, place, category, CAST(n AS INTEGER) AS n FROM (SELECT c_custkey AS doc_id FROM customer), (VALUES (0, 'IDENTIFIANT', 2), (1, 'ADRESSE', 1), (2, 'EMAIL', 2), (3, 'TELEPHONE', 1), (4, 'DATE_NAISSANCE', 1), (5, 'IP', 1), (6, 'PLAQUE', 1), (7, 'SIRET', 1), (8, 'CARTE_BANCAIRE', 1)) v(place, category, n)")
def spans_by_category(spark, sf):
    return pipeline.by_category(pipeline.analyse(_letters(spark, sf))).select("doc_id", "place", "category", F.size("spans").alias("n"))


_LIKE = [("'Zoé Fictif'", "'FICTIF  ZOE'", 1), ("'Alexandre Martinau'", "'Alexandre Martineau'", 1), ("'Alexandre Martinau'", "'Alexandre Dupuis'", 2), ("'Dr Z. Fictif'", "'Zoé Fictif'", 1), ("'Mme'", "'Mme'", 1)]
_LIKE_CASES = " UNION ALL ".join(f"SELECT {i} AS n, {a} AS a, {b} AS b, CAST({c} AS INTEGER) AS codes" for i, (a, b, c) in enumerate(_LIKE))


@_query(f"SELECT c_custkey * 10 + n AS doc_id, codes AS n_codes, concat('[PERSONNE_001] et [PERSONNE_00', codes, ']') AS masked_text FROM customer, ({_LIKE_CASES})")
def names_alike(spark, sf):
    """Accents, case, order and initials do not part names, nor does a slip of the pen; another name does, and titles alone are no name."""
    docs = _table(spark, sf, "customer").join(F.broadcast(spark.sql(_LIKE_CASES)))  # five cases
    docs = docs.select((F.col("c_custkey") * 10 + F.col("n")).alias("doc_id"), "a", "b", F.concat("a", F.lit(" et "), "b").alias("text"))
    doc, a, b = F.col("text"), F.length("a"), F.length("b")
    spans = F.array(text.span(doc, F.lit(0), a, "PERSONNE", values.MODEL), text.span(doc, a + 4, a + 4 + b, "PERSONNE", values.MODEL))
    done = codes.assign(docs.withColumn("spans", spans.cast(text.SPANS)))
    return done.select("doc_id", F.size("code_table").alias("n_codes"), codes.rewrite(doc, F.col("spans"), F.col("codes")).alias("masked_text"))


@_query(
    """SELECT c_custkey AS doc_id, category, CAST(n AS BIGINT) AS n, reason FROM customer,
    (VALUES ('EMAIL', 2, ''), ('TELEPHONE', 1, ''), ('LIEU', 1, ''), ('PERSONNE', 1, 'masquee a 0%')) v(category, n, reason)"""
)
def evaluation_reasons(spark, sf):
    scored = evaluation.score_expected(_scored(spark, sf))
    return scored.groupBy("doc_id", "category", "reason").agg(F.count("*").alias("n"))


@_query("SELECT s_suppkey AS doc_id, round((length(concat(s_suppkey % 200 + 1)) + 12.0) / (length(concat(s_suppkey % 200 + 1)) + 19.0), 6)::DOUBLE AS coverage FROM supplier")
def evaluation_partial(spark, sf):
    """Addresses that are masked in part are listed; a whole one, and one that is missed, are not."""
    docs = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    docs = docs.select(F.col("k").alias("doc_id"), F.expr("concat('Il vit au ', k % 200 + 1, ' rue Exemple; et ', k % 200 + 1, ' avenue Autre; ou au fond')").alias("text"), "k")
    directs = F.create_map(F.lit("ADRESSE"), F.array(F.expr("concat('vit au ', k % 200 + 1, ' rue Exemple')"), F.expr("concat(k % 200 + 1, ' avenue Autre')"), F.lit("au fond")))
    done = pipeline.analyse(text.hold(docs, expected=evaluation.expected(F.col("text"), directs)))
    return evaluation.partial_addresses(evaluation.score_expected(done)).select("doc_id", F.round("coverage", 6).alias("coverage"))


@_query("SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'du fichier' WHEN 3 THEN 'du champ' END AS text, CASE c_custkey % 4 WHEN 1 THEN 'illisible' WHEN 2 THEN 'vide' END AS refused FROM customer")
def review_inputs(spark, sf):
    k = F.col("doc_id") % 4
    docs = _table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    docs = docs.select("doc_id", F.lit("du champ").alias("text"), F.when(k == 0, "du fichier").when(k == 2, " \n").alias("file"), F.when(k == 1, "illisible").alias("error"))
    return review.inputs(docs, "file", "error").select("doc_id", "text", "refused")


@_query(
    f"""WITH {_L} SELECT k AS doc_id, concat('2 remplaces', chr(10), '2 a verifier :', chr(10), '  - [email 1] : {values.REPAIRED_CODE} -> [EMAIL_001]', chr(10), '  - [PERSONNE_', k % 7 + 1, '] : {values.UNKNOWN_CODE}',
    chr(10), '2 non mentionnes : [EMAIL_001], [IP_009]') AS summary, concat('Vu ', {_PARTS["mail"]}, ', [PERSONNE_', k % 7 + 1, '] et ', CASE WHEN k % 2 = 0 THEN 'du fichier' ELSE 'de la session' END) AS restored FROM l"""
)
def reinject_summary(spark, sf):
    """The table of a file goes before that of the session, and a person is told what happened."""
    k = F.col("doc_id")
    entry = lambda code, category, value: F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.array(value).alias("values"))
    mail = F.expr(_PARTS["mail"].replace("k", "doc_id"))
    table = lambda where: F.array(entry("[EMAIL_001]", "EMAIL", mail), entry("[LIEU_001]", "LIEU", F.lit(where)), entry("[IP_009]", "IP", F.lit("192.0.2.1")))
    docs = _letters(spark, sf).select("doc_id", F.when(k % 2 == 0, table("du fichier")).alias("file"), table("de la session").alias("session"))
    docs = docs.withColumn("reply", F.concat(F.lit("Vu [email 1], [PERSONNE_"), (k % 7 + 1).cast("string"), F.lit("] et [LIEU_001]")))
    done = reinjection.reinject(docs.withColumn("code_table", reinjection.choose_table(F.col("file"), F.col("session"))))
    return done.select("doc_id", reinjection.summary().alias("summary"), "restored")
