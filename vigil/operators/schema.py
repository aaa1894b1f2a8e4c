"""Schema drift, migration planning and migration against data.

Column metadata is a DataFrame (table_name, name, type, nullable, description[, position]);
``columns_of`` builds one from a DataFrame's own schema.  Drift is a full outer join of
two such DataFrames on (table_name, name) — a catalog of millions of columns is just a
bigger join.  Names compare case-sensitively on the raw string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from vigil.functions.columns import compact
from vigil.session import Rounds, drop_folder

META_SCHEMA = ("table_name string, name string, type string, nullable boolean, "
               "description string, position int")


def columns_of(df: DataFrame, table: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Column metadata of ``df`` (one row per field, Spark ``simpleString`` types)."""
    spark = spark or df.sparkSession
    rows = [(table, f.name, f.dataType.simpleString(), f.nullable,
             (f.metadata or {}).get("comment", ""), i) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, META_SCHEMA)


def _bool_text(c: Column) -> Column:
    # The reference prints Python booleans.
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def detect_drift(source: DataFrame, target: DataFrame, keys=("table_name", "name"),
                 compare=("type", "nullable")) -> DataFrame:
    """One row per drifted column: keys, change ('added'|'removed'|'modified'),
    changes array<string> ('type: A -> B', 'nullable: True -> False', 'description: ...').

    Missing ``nullable`` counts as True on both sides; only ``compare`` attributes count.
    """
    keys = list(keys)
    s = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in compare], F.lit(True).alias("_s"))
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in compare], F.lit(True).alias("_t"))
    j = s.join(t, keys, "full_outer")
    diffs = []
    for c in compare:
        a, b = F.col(f"s_{c}"), F.col(f"t_{c}")
        if c == "nullable":
            a, b = F.coalesce(a, F.lit(True)), F.coalesce(b, F.lit(True))
            diffs.append(F.when(a != b, F.concat(F.lit("nullable: "), _bool_text(a), F.lit(" -> "), _bool_text(b))))
        else:
            diffs.append(F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{c}: "), F.coalesce(a.cast("string"), F.lit("None")),
                                                           F.lit(" -> "), F.coalesce(b.cast("string"), F.lit("None")))))
    changes = compact(*diffs)
    change = (F.when(F.col("_s").isNull(), "added").when(F.col("_t").isNull(), "removed")
               .when(F.size(changes) > 0, "modified"))
    return (j.select(*keys, change.alias("change"),
                     F.when(F.col("_s").isNotNull() & F.col("_t").isNotNull(), changes)
                      .otherwise(F.array().cast("array<string>")).alias("changes"))
             .filter(F.col("change").isNotNull()))


def drift_summary(source: DataFrame, target: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """Per table: total_source, total_target, added, removed, modified, has_drift."""
    drift = drift if drift is not None else detect_drift(source, target)
    ns = source.groupBy("table_name").agg(F.count(F.lit(1)).alias("total_source"))
    nt = target.groupBy("table_name").agg(F.count(F.lit(1)).alias("total_target"))
    d = drift.groupBy("table_name").agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "modified").alias("modified"))
    out = ns.join(nt, "table_name", "full_outer").join(d, "table_name", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("table_name", z("total_source"), z("total_target"), z("added"), z("removed"),
                      z("modified"),
                      ((F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))
                        + F.coalesce("modified", F.lit(0))) > 0).alias("has_drift"))


def _q(c: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))


def migration_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """Ordered DDL per table: table_name, seq, kind, statement.

    A table only in ``target`` gets one CREATE TABLE; otherwise drops (source order), adds
    (target order), then type and null changes (source order).  Both inputs need ``position``,
    the place of a column in its table.
    """
    for df in (source, target):
        if "position" not in df.columns:
            raise ValueError("migration_plan needs the column 'position'")

    def pos(df):
        return F.col("position")
    s = source.select("table_name", "name", "type", F.coalesce("nullable", F.lit(True)).alias("nullable"),
                      pos(source).alias("pos"), F.lit(True).alias("_s"))
    t = target.select("table_name", "name", "type", F.coalesce("nullable", F.lit(True)).alias("nullable"),
                      pos(target).alias("pos"), F.lit(True).alias("_t"))
    src_tables = s.select("table_name").distinct().withColumn("_has_src", F.lit(True))
    # CREATE for tables without any source column: the column list of one table (bounded by its width).
    created = (t.join(src_tables, "table_name", "left_anti")
                .groupBy("table_name")
                .agg(F.sort_array(F.collect_list(F.struct("pos", "name", "type", "nullable"))).alias("cols"))
                .select("table_name", F.lit(0).alias("phase"), F.lit(0).alias("p"), F.lit(0).alias("sub"),
                        F.lit("create").alias("kind"),
                        F.concat(F.lit("CREATE TABLE "), _q(F.col("table_name")), F.lit(" ("),
                                 F.array_join(F.transform("cols", lambda c: F.concat(
                                     _q(c["name"]), F.lit(" "), c["type"],
                                     F.when(c["nullable"], F.lit("")).otherwise(F.lit(" NOT NULL")))), ", "),
                                 F.lit(");")).alias("statement")))
    j = (s.alias("s").join(t.alias("t"), ["table_name", "name"], "full_outer")
          .join(src_tables, "table_name", "left").filter(F.col("_has_src").isNotNull()))
    tbl = _q(F.col("table_name"))
    col = _q(F.col("name"))
    stmts = F.array(
        F.when(F.col("_t").isNull(), F.struct(
            F.lit(1).alias("phase"), F.col("s.pos").alias("p"), F.lit(0).alias("sub"), F.lit("drop").alias("kind"),
            F.concat(F.lit("ALTER TABLE "), tbl, F.lit(" DROP COLUMN IF EXISTS "), col, F.lit(";")).alias("statement"))),
        F.when(F.col("_s").isNull(), F.struct(
            F.lit(2).alias("phase"), F.col("t.pos").alias("p"), F.lit(0).alias("sub"), F.lit("add").alias("kind"),
            F.concat(F.lit("ALTER TABLE "), tbl, F.lit(" ADD COLUMN "), col, F.lit(" "), F.col("t.type"),
                     F.when(F.col("t.nullable"), F.lit("")).otherwise(F.lit(" NOT NULL")), F.lit(";"))
             .alias("statement"))),
        F.when(F.col("_s").isNotNull() & F.col("_t").isNotNull() & ~F.col("s.type").eqNullSafe(F.col("t.type")),
               F.struct(F.lit(3).alias("phase"), F.col("s.pos").alias("p"), F.lit(0).alias("sub"),
                        F.lit("alter_type").alias("kind"),
                        F.concat(F.lit("ALTER TABLE "), tbl, F.lit(" ALTER COLUMN "), col, F.lit(" TYPE "),
                                 F.col("t.type"), F.lit(";")).alias("statement"))),
        F.when(F.col("_s").isNotNull() & F.col("_t").isNotNull() & (F.col("s.nullable") != F.col("t.nullable")),
               F.struct(F.lit(3).alias("phase"), F.col("s.pos").alias("p"), F.lit(1).alias("sub"),
                        F.when(F.col("t.nullable"), "drop_not_null").otherwise("set_not_null").alias("kind"),
                        F.concat(F.lit("ALTER TABLE "), tbl, F.lit(" ALTER COLUMN "), col,
                                 F.when(F.col("t.nullable"), F.lit(" DROP NOT NULL;"))
                                  .otherwise(F.lit(" SET NOT NULL;"))).alias("statement"))),
    )
    altered = (j.select("table_name", "name", F.explode(F.filter(stmts, lambda x: x.isNotNull())).alias("x"))
                .select("table_name", "x.phase", "x.p", "x.sub", "x.kind", "x.statement", "name"))
    both = altered.unionByName(created.withColumn("name", F.lit("")))
    w = Window.partitionBy("table_name").orderBy("phase", "p", "name", "sub")
    return both.select("table_name", F.row_number().over(w).alias("seq"), "kind", "statement")


def _target_fields(target) -> list[tuple[str, str, bool]]:
    if isinstance(target, T.StructType):
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in target.fields]
    return [(t[0], t[1], t[2] if len(t) > 2 else True) for t in target]


def conform(df: DataFrame, target) -> DataFrame:
    """Reshape data to a target schema — columns in target order, existing ones
    ``try_cast`` to the target type, new ones NULL, columns absent from the target dropped.
    ``target`` is a StructType or [(name, type[, nullable])] (a table's schema, known to
    the planner)."""
    have = set(df.columns)
    out = []
    for name, dtype, _ in _target_fields(target):
        out.append((F.col(name).try_cast(dtype) if name in have else F.lit(None).cast(dtype)).alias(name))
    return df.select(*out)


def migration_safety(df: DataFrame, target) -> DataFrame:
    """What a migration to ``target`` would do to the data, in one scan.

    Rows: column, change ('cast' | 'set_not_null' | 'drop'), rows_affected — values that
    fail the cast, NULLs that violate a new NOT NULL, non-null values lost by a drop.
    """
    fields = {f.name: f for f in df.schema.fields}
    tgt = {n: (t, nl) for n, t, nl in _target_fields(target)}
    checks = []
    for name, (dtype, nullable) in tgt.items():
        if name not in fields:
            continue
        c = F.col(name)
        if fields[name].dataType.simpleString() != dtype:
            checks.append((name, "cast", F.count_if(c.isNotNull() & c.try_cast(dtype).isNull())))
        if not nullable:
            checks.append((name, "set_not_null", F.count_if(c.isNull())))
    for name in fields:
        if name not in tgt:
            checks.append((name, "drop", F.count_if(F.col(name).isNotNull())))
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, change string, rows_affected bigint")
    wide = df.agg(*[expr.alias(f"_c{i}") for i, (_, _, expr) in enumerate(checks)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.lit(k).alias("change"), F.col(f"_c{i}").alias("rows_affected"))
        for i, (n, k, _) in enumerate(checks)])).alias("x")).select("x.*")


def json_type_class(variant_type: Column) -> Column:
    """Coarse JSON type of a ``schema_of_variant`` string."""
    t = F.upper(variant_type)
    return (F.when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), "number")
             .when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
             .when(t.isin("VOID", "NULL"), "null")  # a JSON null is a VOID variant
             .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("other"))


def json_keys_observed(df: DataFrame, json_col: str, by: list[str] | None = None) -> DataFrame:
    """Keys and value types seen in a JSON text column: (by..., key, json_type, n)."""
    by = by or []
    kv = df.select(*by, F.explode(F.from_json(json_col, "map<string,variant>")).alias("key", "v"))
    return (kv.groupBy(*by, "key", json_type_class(F.schema_of_variant("v")).alias("json_type"))
              .agg(F.count(F.lit(1)).alias("n")))


def json_key_drift(df: DataFrame, json_col: str, period: Column) -> DataFrame:
    """Drift of a semi-structured column between two periods ('before' / 'after').

    Per key: types_before, types_after ('|'-joined sorted type classes), change.  One pass:
    keys and types are exploded once and both periods are conditional aggregates of the same
    ``groupBy(key)`` (type sets are bounded by the handful of JSON types).
    """
    kv = df.select(period.alias("_period"),
                   F.explode(F.from_json(json_col, "map<string,variant>")).alias("key", "v"))
    typed = kv.select("_period", "key", json_type_class(F.schema_of_variant("v")).alias("t"))
    per_key = typed.groupBy("key").agg(
        F.array_sort(F.collect_set(F.when(F.col("_period") == "before", F.col("t")))).alias("b"),
        F.array_sort(F.collect_set(F.when(F.col("_period") == "after", F.col("t")))).alias("a"))
    tb = F.when(F.size("b") > 0, F.array_join("b", "|"))
    ta = F.when(F.size("a") > 0, F.array_join("a", "|"))
    j = per_key.select("key", tb.alias("types_before"), ta.alias("types_after"))
    change = (F.when(F.col("types_before").isNull(), "added").when(F.col("types_after").isNull(), "removed")
               .when(F.col("types_before") != F.col("types_after"), "modified"))
    return j.select("key", "types_before", "types_after", change.alias("change")).filter(F.col("change").isNotNull())


# ---------------------------------------------------------------- nested documents

def json_value_type(v: Column) -> Column:
    """Type of one variant value: integer, number, string, boolean, null, object, array or other."""
    t = F.upper(F.schema_of_variant(v))
    return (F.when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), "integer").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
             .otherwise(json_type_class(t)))


def json_malformed(df: DataFrame, json_col: str, period: Column) -> DataFrame:
    """(period, n_rows, n_null, n_malformed): texts that are no JSON are counted, not lost."""
    text = F.col(f"`{json_col}`")
    return df.select(period.alias("period"), text.alias("t"), F.try_parse_json(text).alias("v")).groupBy("period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("t").isNull()).alias("n_null"),
        F.count_if(F.col("t").isNotNull() & F.col("v").isNull()).alias("n_malformed"))


def json_path_types(df: DataFrame, json_col: str, by: dict[str, Column]) -> DataFrame:
    """(by..., path, type, n) for every path of a JSON text column, at any depth; runs its rounds when called.

    ``$`` is the document, ``.key`` a member of an object and ``[]`` all elements of an array.  Round k explodes the
    containers k steps deep (``variant_explode``) and is written; rounds end with the deepest document.  Each
    round's paths and types are counted map-side.
    """
    spark, names = df.sparkSession, list(by)
    rounds, k = Rounds(spark, "paths"), 0
    documents = df.select(*[c.alias(n) for n, c in by.items()], F.lit("$").alias("path"), F.try_parse_json(F.col(f"`{json_col}`")).alias("v"))
    counted = Rounds(spark, "path_types")
    values = documents.where(F.col("v").isNotNull())
    while True:
        typed = values.withColumn("type", json_value_type(F.col("v")))
        # null members are variant nulls: they have a type and are counted
        now = rounds.write(k, typed.where(F.col("type").isin("object", "array")))
        counted.write(k, typed.groupBy(*names, "path", "type").agg(F.count(F.lit(1)).alias("n")))
        if now.isEmpty():
            break
        step = "CASE WHEN m.key IS NULL THEN '[]' ELSE concat('.', m.key) END"
        values = spark.sql(f"SELECT {''.join(f'`{n}`, ' for n in names)} concat(path, {step}) AS path, m.value AS v "
                           "FROM {now}, LATERAL variant_explode(v) AS m", now=now)
        k += 1
    drop_folder(spark, rounds.path)
    return counted.all().drop("round").groupBy(*names, "path", "type").agg(F.sum("n").alias("n"))


def lattice_type(types: Column) -> Column:
    """Least type above a sorted set of types: null lies below all, integer below number, mixed above all."""
    known = F.array_remove(types, "null")
    return (F.when(F.size(known) == 0, "null").when(F.size(known) == 1, known[0])
             .when(known == F.array(F.lit("integer"), F.lit("number")), "number").otherwise("mixed"))


def json_path_drift(df: DataFrame, json_col: str, period: Column) -> DataFrame:
    """S5 at any depth: per path its type, nullability and count before and after, and the change
    (added, removed, widened, narrowed, changed or same).  ``period`` gives 'before' or 'after'.

    A type is widened if all its earlier values still fit (integer to number, anything to mixed, a null now and
    then), narrowed the other way round, else changed.
    """
    found = json_path_types(df, json_col, {"period": period})

    def side(name):
        here = F.col("period") == name
        types = F.array_sort(F.collect_set(F.when(here, F.col("type"))))
        return [types.alias(f"t_{name}"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"n_{name}")]

    wide = found.groupBy("path").agg(*side("before"), *side("after"))
    for name in ("before", "after"):
        seen = F.size(f"t_{name}") > 0
        wide = (wide.withColumn(f"type_{name}", F.when(seen, lattice_type(F.col(f"t_{name}"))))
                .withColumn(f"nullable_{name}", F.when(seen, F.array_contains(f"t_{name}", "null"))))
    b, a = F.col("type_before"), F.col("type_after")
    nb, na = F.col("nullable_before"), F.col("nullable_after")
    change = (F.when(b.isNull(), "added").when(a.isNull(), "removed")
               .when(b == a, F.when(nb == na, "same").when(na, "widened").otherwise("narrowed"))
               .when((b == "null") | (a == "mixed") | ((b == "integer") & (a == "number")), "widened")
               .when((a == "null") | (b == "mixed") | ((b == "number") & (a == "integer")), "narrowed").otherwise("changed"))
    return wide.select("path", "type_before", "type_after", "nullable_before", "nullable_after", "n_before", "n_after", change.alias("change"))
