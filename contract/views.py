"""Catalog tables derived from the driver's tables, in Spark and, independently, in SQL.

Both sides follow the same arithmetic on part and lineitem keys.  Four projects share the parts
as source keys; lineitem rows are versions of translations, of which the newest counts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions.hashing import history_id, source_hash
from lexilake.operators.audit import canonical_entries, canonical_source
from lexilake.plans.catalog import Catalog
from lexilake.schemas import PLACEHOLDERS
from lexilake.session import durable, shuffled

LOCALES_SQL = """
  SELECT * FROM (VALUES (0,'en',true),(0,'de',false),(0,'es',false),(0,'fr',false),(0,'pt-BR',false),(0,'ja',false),
    (1,'en',true),(1,'de',false),(1,'es',false),(1,'fr',false),(1,'pt-BR',false),(1,'ja',false),
    (2,'en',true),(2,'de',false),(2,'es',false),(2,'fr',false),(2,'pt-BR',false),(2,'ja',false),
    (3,'en',true),(3,'de',false),(3,'es',false),(3,'pt-BR',false),(3,'ja',false)) AS t(project, locale, is_source)"""
GLOSSARY_SQL = """
  SELECT * FROM (VALUES (0,'ring','es','anillo'),(0,'ring','de','ring'),(0,'widget','de','Teil'),
    (1,'ring','es','anillo'),(1,'small','fr','petit'),(2,'for','pt-BR','para'),(2,'loves','de','liebt'),
    (2,'rin','es','nunca'),(3,' ','es','red'),(3,'{','de','{'),(3,'red widget','es','red'))
    AS t(project, source_term, locale, target_term)"""
PLATFORMS_SQL = """
  SELECT * FROM (VALUES (0,'ios'),(1,'android'),(2,'ios'),(3,'android')) AS t(project, platform)"""
RULES = [
    (0, "dotted.lower", 4, ["economy", "standard", "promo", "tmp"], ["tmp.", "debug."]),
    (1, "snake", 3, [], []),
    (2, "kebab", 2, [], ["tmp", "promo"]),
    (3, "dotted.lower", 3, ["economy"], ["promo.", "tmp."]),
]


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _spark_list(values):
    return "cast(array(" + ", ".join(f"'{v}'" for v in values) + ") as array<string>)"


class Lake:
    """The derived tables over one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @staticmethod
    def parts_of(part: DataFrame) -> DataFrame:
        """A source key per part, from a table or a stream of parts."""
        k, name = F.col("p_partkey"), F.col("p_name")
        kind = (F.when(k % 29 == 0, "plural").when(k % 5 == 0, "buy").when(k % 7 == 0, "loves").otherwise("plain"))
        key = F.concat(
            F.when(k % 37 == 0, "tmp.").otherwise(""), F.lower("p_type"),
            F.when(k % 17 == 0, ".Item").otherwise(".item"), F.when(k % 23 == 0, ".a.b.c").otherwise(""),
            F.lit(".k"), k.cast("string"))
        text = (
            F.when(kind == "plural", F.concat(F.lit("{count, plural, one {# "), name, F.lit("} other {# "), name,
                                              F.lit("s}}")))
            .when(kind == "buy", F.concat(F.lit("Buy {name}: "), name, F.lit(" for {name}")))
            .when(kind == "loves", F.concat(F.lit("{0} loves {1} "), name))
            .otherwise(name))
        spec = lambda example, kind_: F.struct(
            F.lit(example).cast("string").alias("example"), F.lit(kind_).alias("type"))
        by_kind = (
            F.when(kind == "plural", F.create_map(F.lit("count"), spec(None, "number")))
            .when(kind == "buy", F.create_map(F.lit("name"), spec("Ann", "string")))
            .when(kind == "loves", F.create_map(F.lit("0"), spec(None, "string"), F.lit("1"), spec(None, "number")))
            .otherwise(F.create_map().cast(PLACEHOLDERS)))
        expires = F.when(k % 11 == 0, F.create_map(F.lit("expires"), spec(None, "date"))).otherwise(
            F.create_map().cast(PLACEHOLDERS))
        rows = part.select(
            k.alias("pk"), key.alias("key"), text.alias("text"),
            F.when(k % 13 != 0, F.col("p_brand")).alias("description"),
            F.map_concat(by_kind, expires).alias("placeholders"))
        return rows.withColumn("source_hash", source_hash(
            F.col("text"), F.col("description"), F.col("placeholders")))

    @cached_property
    def parts(self) -> DataFrame:
        """One row per part: the source key all projects share, stored once as a catalog would be."""
        # The file is small for its rows, and one block of it would keep all that is made of them in one task.
        return durable(self.parts_of(self.table("part").repartition(self.tasks, "p_partkey")))

    @staticmethod
    def source_of(parts: DataFrame) -> DataFrame:
        return parts.select(
            F.explode(F.array(*[F.lit(p) for p in range(4)])).alias("project"), F.lit("en").alias("locale"), "*")

    @cached_property
    def source(self) -> DataFrame:
        return self.source_of(self.parts)

    @cached_property
    def versions(self) -> DataFrame:
        locales = F.element_at(F.array(*[F.lit(c) for c in (
            "de", "es", "fr", "pt-BR", "zh-Hans", "fil", "es-419")]), (F.col("l_linenumber") % 7 + 1).cast("int"))
        return self.table("lineitem").select(
            (F.col("l_suppkey") % 4).cast("int").alias("project"), locales.alias("locale"),
            F.col("l_partkey").alias("pk"), (F.col("l_orderkey") % 31 == 0).alias("orphan"),
            F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
            F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").alias("price"),
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))

    @cached_property
    def entries(self) -> DataFrame:
        # A key has a few dozen versions: dealt by key first, no task sorts its whole share of the scan, and the join needs no
        # second shuffle.  The number of tasks is given, as AQE would merge them by their compressed size.
        newest = self.versions.repartition(self.tasks, "pk").groupBy("project", "locale", "pk", "orphan").agg(
            F.max(F.struct("at", "ok", "ln", "sk", "price", "flag", "status")).alias("v"))
        source = self.parts.select("pk", "key", "text", "source_hash")
        ok, text = F.col("v.ok"), F.col("text")
        swapped = F.replace(F.replace(F.replace(text, F.lit("{0}"), F.lit("{#}")), F.lit("{1}"), F.lit("{0}")),
                            F.lit("{#}"), F.lit("{1}"))
        changed = (
            F.when(ok % 13 == 0, F.lit("  ")).when(ok % 11 == 0, F.replace(text, F.lit("{name}"), F.lit("")))
            .when(ok % 17 == 0, swapped).otherwise(text))
        stale_hash = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("old"), text), 256))
        return newest.join(shuffled(source), "pk").select(
            "project", "locale",
            F.when(F.col("orphan"), F.concat(F.lit("legacy.k"), F.col("pk").cast("string"))).otherwise(
                F.col("key")).alias("key"),
            F.when(ok % 3 == 0, F.replace(changed, F.lit("ring"), F.lit("anillo"))).otherwise(changed).alias("text"),
            (F.col("v.flag") == "R").alias("reviewed"), (ok % 9 == 0).alias("stale"),
            F.when(F.col("v.status") == "F", stale_hash).otherwise(F.col("source_hash")).alias("source_hash"),
            F.lit("machine").alias("provider"),
            F.concat(F.lit("m"), (F.col("v.ln") % 3).cast("string")).alias("model_version"),
            F.col("v.at").alias("translated_at"), "pk")

    @cached_property
    def cache(self) -> DataFrame:
        source = self.parts.select("pk", "text", "source_hash")
        dead = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("dead"), F.col("text")), 256))
        return self.versions.join(shuffled(source), "pk").select(
            "project", F.when(F.col("ok") % 10 == 0, dead).otherwise(F.col("source_hash")).alias("source_hash"),
            "locale", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("cfg"), F.col("flag")), 256)).alias("config_hash"),
            F.concat(F.lit("m"), (F.col("ok") % 3).cast("string")).alias("model_version"),
            F.concat("locale", F.lit(": "), F.col("text")).alias("text"), F.col("at").alias("cached_at"))

    @cached_property
    def configs(self) -> DataFrame:
        return self.spark.sql("SELECT * FROM VALUES (0,'A'),(1,'N'),(2,'R'),(3,'A') AS t(project, flag)").select(
            "project", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("cfg"), F.col("flag")), 256)).alias("config_hash"))

    @cached_property
    def locales(self) -> DataFrame:
        return self.spark.sql(LOCALES_SQL)

    @cached_property
    def glossary(self) -> DataFrame:
        return self.spark.sql(GLOSSARY_SQL)

    @cached_property
    def platforms(self) -> DataFrame:
        return self.spark.sql(PLATFORMS_SQL)

    @cached_property
    def rules(self) -> DataFrame:
        rows = ", ".join(f"({p}, '{c}', {d}, {_spark_list(s)}, {_spark_list(f)})" for p, c, d, s, f in RULES)
        return self.spark.sql(
            f"SELECT * FROM VALUES {rows} AS t(project, key_case, max_depth, scopes, forbidden_prefixes)")

    @cached_property
    def platform_entries(self) -> DataFrame:
        """What the platforms hold: rows dropped, reworded, retyped and added by key arithmetic."""
        columns = ["project", "locale", "key", "text", "placeholders", "pk"]
        pks = self.parts.select("pk", F.col("key").alias("_key"))
        source = canonical_source(self.source).join(
            shuffled(pks.withColumnRenamed("_key", "key")), "key").select(*columns)
        targets = self.locales.filter("not is_source").select("project", "locale")
        translated = canonical_entries(
            self.entries.join(targets, ["project", "locale"], "left_semi"), self.source).select(*columns)
        extra = source.filter(F.col("pk") % 30 == 5).select(
            "project", F.lit("de").alias("locale"), F.concat(F.lit("extra.k"), F.col("pk").cast("string")).alias("key"),
            "text", "placeholders", "pk")
        kept = source.unionByName(translated).filter((F.col("pk") + F.length("locale")) % 20 != 3)
        retyped = F.transform("placeholders", lambda p: F.struct(
            p["name"].alias("name"), F.when((p["type"] == "string") & (F.col("pk") % 45 == 0), F.lit("number"))
            .otherwise(p["type"]).alias("type")))
        return kept.unionByName(extra).join(self.platforms, "project").select(
            "project", "platform", "locale", "key",
            F.when(F.col("pk") % 25 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
            F.lit(None).cast("string").alias("comment"), retyped.alias("placeholders"), "pk")

    @staticmethod
    def history_of(events: DataFrame) -> DataFrame:
        op = (F.when(F.col("event_type") == "signup", "init").when(F.col("event_type") == "view", "sync")
              .when(F.col("event_type") == "click", "import").when(F.col("event_type") == "purchase", "rename")
              .otherwise("rollback"))
        return events.select(
            (F.col("user_id") % 4).cast("int").alias("project"), F.col("event_id").alias("line_no"),
            history_id(F.col("ts"), op).alias("id"), op.alias("op"), F.col("user_id").cast("string").alias("actor"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))

    @cached_property
    def history(self) -> DataFrame:
        return self.history_of(self.table("events"))

    @staticmethod
    def states_of(events: DataFrame) -> DataFrame:
        """Progress reports, several per project; here a project is a user of the event log."""
        done = F.floor("value").cast("int")
        return events.select(
            F.col("user_id").cast("int").alias("project"), done.alias("completed_translations"),
            F.greatest(F.lit(0), done + F.col("event_id").cast("int") % 7 * 10 - 5).alias("total_translations"),
            F.when(F.col("event_type") == "error", "interrupted").otherwise("running").alias("status"),
            F.col("ts").alias("updated_at"), F.col("event_id"),
            F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("config_hash"),
            F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("source_hash"))

    @cached_property
    def states(self) -> DataFrame:
        return self.states_of(self.table("events"))

    @cached_property
    def state(self) -> DataFrame:
        """Latest report per project."""
        rest = ["completed_translations", "total_translations", "status", "config_hash", "source_hash"]
        return self.states.groupBy("project").agg(F.max_by(
            F.struct(*rest, "updated_at"), F.struct("updated_at", "event_id")).alias("s")).select("project", "s.*")

    @cached_property
    def catalog(self) -> Catalog:
        return Catalog(
            source=self.source, entries=self.entries, locales=self.locales, rules=self.rules, configs=self.configs,
            cache=self.cache, glossary=self.glossary, platforms=self.platforms,
            platform_entries=self.platform_entries, history=self.history, state=self.state)


# ---------------------------------------------------------------------------------------------
# The same tables in DuckDB SQL, as common table expressions.

BLANK = r"regexp_full_match({0}, '[\s\x{{FEFF}}\x{{00A0}}\x{{2000}}-\x{{200A}}]*')"


def blank(column: str) -> str:
    return "(" + column + " IS NULL OR " + BLANK.format(column) + ")"


def names(text: str) -> str:
    return rf"regexp_extract_all({text}, '\{{([\w.-]+)\}}', 1)"


def parity(source: str, target: str) -> str:
    digits = "list_filter({0}, lambda n: regexp_full_match(n, '[0-9]+'))"
    return (f"(list_sort({names(source)}) = list_sort({names(target)}) AND "
            f"{digits.format(names(source))} = {digits.format(names(target))})")


def used_placeholders(text: str, declared: str) -> str:
    """Names in the text by first appearance, then declared ones it leaves out, with types."""
    firsts = (f"list_filter({names(text)}, lambda n, i: NOT list_contains("
              f"list_slice({names(text)}, 1, i - 1), n))")
    types = f"coalesce(list_filter({declared}, lambda d: d.n = x)[1].t, 'string')"
    unused = f"list_filter({declared}, lambda d: NOT list_contains({names(text)}, d.n))"
    return (f"list_concat(list_transform({firsts}, lambda x: {{'n': x, 't': {types}}}), "
            f"list_transform({unused}, lambda d: {{'n': d.n, 't': d.t}}))")


def signature(text: str, declared: str) -> str:
    return (f"array_to_string(list_sort(list_transform({used_placeholders(text, declared)}, "
            "lambda p: p.n || ':' || p.t)), '|')")


_NL = "chr(10)"

PARTS = f"""
  SELECT pk, key, text, description, ph, 'sha256:' || sha256(canonical || {_NL}) AS source_hash, canonical FROM (
    SELECT *, '{{' || {_NL}
      || CASE WHEN description IS NULL THEN '' ELSE '  "description": ' || to_json(description)::VARCHAR || ',' || {_NL} END
      || '  "placeholders": ' || CASE WHEN len(ph) = 0 THEN '{{}}' ELSE '{{' || {_NL} || array_to_string(
           list_transform(ph, lambda x: '    "' || x.n || '": {{' || {_NL}
             || CASE WHEN x.e IS NULL THEN '' ELSE '      "example": ' || to_json(x.e)::VARCHAR || ',' || {_NL} END
             || '      "type": "' || x.t || '"' || {_NL} || '    }}'), ',' || {_NL}) || {_NL} || '  }}' END
      || ',' || {_NL} || '  "text": ' || to_json(text)::VARCHAR || {_NL} || '}}' AS canonical
    FROM (
      SELECT p_partkey AS pk,
        CASE WHEN p_partkey % 37 = 0 THEN 'tmp.' ELSE '' END || lower(p_type)
          || CASE WHEN p_partkey % 17 = 0 THEN '.Item' ELSE '.item' END
          || CASE WHEN p_partkey % 23 = 0 THEN '.a.b.c' ELSE '' END || '.k' || p_partkey AS key,
        CASE WHEN p_partkey % 29 = 0 THEN '{{count, plural, one {{# ' || p_name || '}} other {{# ' || p_name || 's}}}}'
             WHEN p_partkey % 5 = 0 THEN 'Buy {{name}}: ' || p_name || ' for {{name}}'
             WHEN p_partkey % 7 = 0 THEN '{{0}} loves {{1}} ' || p_name ELSE p_name END AS text,
        CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS description,
        list_sort(list_concat(
          CASE WHEN p_partkey % 29 = 0 THEN [{{'n': 'count', 't': 'number', 'e': NULL::VARCHAR}}]
               WHEN p_partkey % 5 = 0 THEN [{{'n': 'name', 't': 'string', 'e': 'Ann'}}]
               WHEN p_partkey % 7 = 0 THEN [{{'n': '0', 't': 'string', 'e': NULL::VARCHAR}},
                                            {{'n': '1', 't': 'number', 'e': NULL::VARCHAR}}]
               ELSE [] END,
          CASE WHEN p_partkey % 11 = 0 THEN [{{'n': 'expires', 't': 'date', 'e': NULL::VARCHAR}}] ELSE [] END)) AS ph
      FROM part))"""

VERSIONS = """
  SELECT (l_suppkey % 4)::INT AS project,
    (['de','es','fr','pt-BR','zh-Hans','fil','es-419'])[(l_linenumber % 7 + 1)::INT] AS locale,
    l_partkey AS pk, l_orderkey % 31 = 0 AS orphan, l_shipdate AS shipped, l_orderkey AS ok, l_linenumber AS ln,
    l_suppkey AS sk, l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS status FROM lineitem"""

ENTRIES = """
  SELECT project, locale, CASE WHEN orphan THEN 'legacy.k' || pk ELSE key END AS key,
    CASE WHEN ok % 3 = 0 THEN replace(changed, 'ring', 'anillo') ELSE changed END AS text,
    flag = 'R' AS reviewed, ok % 9 = 0 AS stale,
    CASE WHEN status = 'F' THEN 'sha256:' || sha256('old' || src) ELSE source_hash END AS source_hash,
    'machine' AS provider, 'm' || (ln % 3) AS model_version, shipped AS translated_at, pk, src
  FROM (
    SELECT v.*, p.key, p.source_hash, p.text AS src,
      CASE WHEN ok % 13 = 0 THEN '  ' WHEN ok % 11 = 0 THEN replace(p.text, '{name}', '')
           WHEN ok % 17 = 0 THEN replace(replace(replace(p.text, '{0}', '{#}'), '{1}', '{0}'), '{#}', '{1}')
           ELSE p.text END AS changed
    FROM (SELECT *, row_number() OVER (PARTITION BY project, locale, pk, orphan
            ORDER BY shipped DESC, ok DESC, ln DESC, sk DESC, price DESC, flag DESC, status DESC) AS rn
          FROM v_versions) v JOIN v_parts p USING (pk) WHERE rn = 1)"""

CACHE = """
  SELECT project, CASE WHEN ok % 10 = 0 THEN 'sha256:' || sha256('dead' || p.text) ELSE p.source_hash END AS source_hash,
    locale, 'sha256:' || sha256('cfg' || flag) AS config_hash, 'm' || (ok % 3) AS model_version,
    locale || ': ' || p.text AS text, shipped AS cached_at
  FROM v_versions JOIN v_parts p USING (pk)"""

PLATFORM = f"""
  SELECT b.project, p.platform, locale, key, CASE WHEN pk % 25 = 4 THEN text || '!' ELSE text END AS text,
    CASE WHEN pk % 45 = 0 THEN replace(sig, ':string', ':number') ELSE sig END AS sig, pk
  FROM (
    SELECT project, 'en' AS locale, key, text, {signature('text', 'ph')} AS sig, pk FROM v_source
      WHERE (pk + 2) % 20 <> 3
    UNION ALL
    SELECT e.project, e.locale, e.key, e.text, {signature('e.text', 'coalesce(s.ph, [])')} AS sig, e.pk
      FROM v_entries e SEMI JOIN v_targets USING (project, locale) LEFT JOIN v_source s
        ON s.project = e.project AND s.key = e.key
      WHERE (e.pk + length(e.locale)) % 20 <> 3
    UNION ALL
    SELECT project, 'de', 'extra.k' || pk, text, {signature('text', 'ph')}, pk FROM v_source WHERE pk % 30 = 5) b
  JOIN v_platforms p USING (project)"""

HISTORY = """
  SELECT (user_id % 4)::INT AS project, event_id AS line_no,
    strftime(ts, '%Y%m%d%H%M%S') || '-' || op AS id, op, user_id::VARCHAR AS actor,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'sync' WHEN 'click' THEN 'import'
          WHEN 'purchase' THEN 'rename' ELSE 'rollback' END AS op FROM events)"""

STATES = """
  SELECT user_id::INT AS project, floor(value)::INT AS completed_translations,
    greatest(0, floor(value)::INT + (event_id % 7)::INT * 10 - 5) AS total_translations,
    CASE WHEN event_type = 'error' THEN 'interrupted' ELSE 'running' END AS status, ts AS updated_at, event_id,
    'c' || (event_id % 3) AS config_hash, 's' || (user_id % 2) AS source_hash FROM events"""

CTES = {
    "v_parts": PARTS,
    "v_source": "SELECT p.project::INT AS project, 'en' AS locale, v.* FROM v_parts v, (VALUES (0),(1),(2),(3)) p(project)",
    "v_versions": VERSIONS,
    "v_entries": ENTRIES,
    "v_locales": LOCALES_SQL,
    "v_targets": "SELECT project, locale FROM v_locales WHERE NOT is_source",
    "v_configs": "SELECT project, 'sha256:' || sha256('cfg' || flag) AS config_hash "
                 "FROM (VALUES (0,'A'),(1,'N'),(2,'R'),(3,'A')) t(project, flag)",
    "v_cache": CACHE,
    "v_glossary": GLOSSARY_SQL,
    "v_platforms": PLATFORMS_SQL,
    "v_rules": "SELECT * FROM (VALUES " + ", ".join(
        f"({p}, '{c}', {d}, {_sql_list(s)}, {_sql_list(f)})" for p, c, d, s, f in RULES)
        + ") t(project, key_case, max_depth, scopes, forbidden_prefixes)",
    "v_platform": PLATFORM,
    "v_history": HISTORY,
    "v_states": STATES,
    "v_state": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project "
               "ORDER BY updated_at DESC, event_id DESC) AS rn FROM v_states) WHERE rn = 1",
}

def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the common table expressions that ``body`` needs in front of it, in dependency order."""
    available = {**CTES, **(extra or {})}
    chosen: list[str] = []

    def need(text: str) -> None:
        for name, sql in available.items():
            if name not in chosen and text is not sql and _mentions(text, name):
                need(sql)
                if name not in chosen:
                    chosen.append(name)

    need(body)
    if not chosen:
        return body
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({available[name]})" for name in chosen) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None
