"""Declarative data-quality rules, evaluated in one pass over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan.functions.text import display, is_blank


@dataclass(frozen=True)
class Rule:
    """A named condition that marks a row as bad.

    A condition that evaluates to NULL passes: unknown is not a violation
    unless a rule says so.
    """

    name: str
    violated: Column
    reason: Column | str


FAILED = "failed_rules"


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``failed_rules``: (rule_name, violation_reason) in rule order."""

    def entry(rule: Rule) -> Column:
        reason = F.lit(rule.reason) if isinstance(rule.reason, str) else rule.reason
        bad = F.coalesce(rule.violated, F.lit(False))
        return F.when(bad, F.struct(F.lit(rule.name).alias("rule_name"), reason.alias("violation_reason")))

    return df.withColumn(FAILED, F.array_compact(F.array(*[entry(r) for r in rules])))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(FAILED) == 0).drop(FAILED)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(FAILED) > 0)


def quarantine(checked: DataFrame, table: str, key: Column, run_id: str, every_rule: bool = False) -> DataFrame:
    """Rows for the quarantine table: the first failed rule, or all of them."""
    bad = rejected(checked)
    rule = F.explode(FAILED) if every_rule else F.get(F.col(FAILED), F.lit(0))
    return bad.select(display(key, "(unknown)").alias("record_key"), rule.alias("r")).select(
        F.lit(run_id).alias("run_id"), F.lit(table).alias("source_table"), "r.rule_name", "r.violation_reason", "record_key"
    )


# ── rules of the catalog tables ──────────────────────────────────────────


def blank(*cols: str) -> Column:
    out = is_blank(F.col(cols[0]))
    for c in cols[1:]:
        out = out | is_blank(F.col(c))
    return out


def null(*cols: str) -> Column:
    out = F.col(cols[0]).isNull()
    for c in cols[1:]:
        out = out | F.col(c).isNull()
    return out


def text_of(col: str) -> Column:
    return display(F.col(col), "None")


# Accepted relevance labels.
LABELS = ["Exact", "Partial", "Irrelevant"]


def product_rules() -> list[Rule]:
    bounds = (F.col("rating_count") < 0) | (F.col("average_rating") < 0) | (F.col("average_rating") > 5)
    return [
        Rule("null_product_id", blank("product_id"), "product_id is null or empty"),
        Rule("empty_product_name", blank("product_name"), "product_name is null or empty"),
        Rule(
            "invalid_ratings_bounds",
            F.coalesce(F.col("rating_count") < 0, F.lit(False)) | F.coalesce(bounds, F.lit(False)),
            F.concat(
                F.lit("average_rating ("), text_of("average_rating"), F.lit(") or rating_count ("), text_of("rating_count"),
                F.lit(") out of valid bounds"),
            ),
        ),
    ]


def query_rules() -> list[Rule]:
    return [
        Rule("null_query_id", blank("query_id"), "query_id is null or empty"),
        Rule("empty_query_string", blank("query"), "query string is empty or null"),
    ]


def label_rules() -> list[Rule]:
    known = F.coalesce(F.col("label").isin(LABELS), F.lit(False))
    return [
        Rule("null_keys", null("id", "query_id", "product_id"), "id, query_id or product_id key is null"),
        Rule(
            "invalid_label_value", ~known,
            F.concat(F.lit("label value '"), text_of("label"), F.lit("' is not one of ['Exact', 'Partial', 'Irrelevant']")),
        ),
    ]


def named_rules(entity: str) -> list[Rule]:
    """Brand and category: a key and a name."""
    return [
        Rule("null_keys", null(f"{entity}_id"), f"{entity}_id key is null"),
        Rule(f"blank_{entity}_name", blank(f"{entity}_name"), f"{entity}_name is blank or empty"),
    ]


def attribute_rules() -> list[Rule]:
    return [
        Rule("null_keys", null("attribute_id", "product_id"), "attribute_id or product_id key is null"),
        Rule("empty_attribute_specs", blank("attribute_name", "attribute_value"), "attribute_name or attribute_value is empty"),
    ]


def review_rules() -> list[Rule]:
    s = F.col("sentiment_score")
    return [
        Rule("null_keys", null("review_summary_id", "product_id"), "review_summary_id or product_id key is null"),
        Rule(
            "invalid_sentiment_score", (s < -1) | (s > 1),
            F.concat(F.lit("sentiment_score ("), text_of("sentiment_score"), F.lit(") is out of valid bounds [-1, 1]")),
        ),
    ]


def pricing_rules() -> list[Rule]:
    sell, full = F.col("selling_price"), F.col("list_price")
    no = F.lit(False)
    return [
        Rule("null_keys", null("price_id", "product_id"), "price_id or product_id key is null"),
        Rule(
            "invalid_prices", F.coalesce(sell < 0, no) | F.coalesce(full < 0, no) | F.coalesce(sell > full, no),
            F.concat(
                F.lit("selling_price ("), text_of("selling_price"), F.lit(") > list_price ("), text_of("list_price"),
                F.lit(") or negative value"),
            ),
        ),
        Rule(
            "invalid_currency", F.coalesce(F.col("currency") != "INR", F.lit(True)),
            F.concat(F.lit("currency '"), text_of("currency"), F.lit("' is not INR")),
        ),
    ]


def product_master_rules() -> list[Rule]:
    return [Rule("null_keys", blank("product_id"), "product_id is null or empty")]


def identified_rules() -> list[Rule]:
    """Header-resolved catalogs: an id and a name."""
    bad = blank("product_id") | blank("product_name")
    return [Rule("missing_id_or_name", bad, "Missing product_id or product_name")]


# ── duplicates ───────────────────────────────────────────────────────────


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[Column], copies: str = "copies") -> DataFrame:
    """One row per key, the first by ``order``, and how many there were.

    An aggregate, not a window: every map task already reduces a key to one
    row, so a key that holds a third of the table does not fill one task.
    """
    rest = [c for c in df.columns if c not in keys]
    survivor = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(survivor.alias("_row"), F.count(F.lit(1)).alias(copies)).select(*keys, "_row.*", copies)


def best_record(df: DataFrame, key: str | None, tie: Sequence[Column] = ()) -> DataFrame:
    """Newest, then best-rated, then most-rated row per key; whole rows without a key."""
    if key is None:
        return df.dropDuplicates()
    wanted = [F.col(c) for c in ("updated_at", "rating", "rating_count") if c in df.columns]
    order = wanted + (list(tie) or [F.xxhash64(*df.columns)])
    rest = [c for c in df.columns if c != key]
    # NULL sorts lowest inside a struct, so a missing rating loses
    best = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def duplicate_keys(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Most repeated keys, with the table's totals beside them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    totals = counts.agg(
        F.sum("copies").alias("total"), (F.sum("copies") - F.count(key)).alias("duplicates")
    ).select(F.struct("total", "duplicates")).scalar()
    worst = counts.filter(F.col("copies") > 1).orderBy(F.col("copies").desc(), F.col(key).asc_nulls_first()).limit(n)
    return worst.select(key, "copies", totals["total"].alias("total"), totals["duplicates"].alias("duplicates"))


# ── reports and gates ────────────────────────────────────────────────────


def dq_report(checked: DataFrame, table: str, copies: str = "copies") -> DataFrame:
    """Read, written, duplicate and invalid counts and the quality score, in one aggregate."""
    read = F.coalesce(F.sum(copies), F.lit(0))
    kept = F.count(F.lit(1))
    written = F.count_if(F.size(FAILED) == 0)
    counts = checked.agg(read.alias("records_read"), written.alias("records_written"), (read - kept).alias("duplicates"))
    return counts.select(
        F.lit(table).alias("table_name"), "records_read", "records_written", "duplicates",
        (F.col("records_read") - F.col("records_written") - F.col("duplicates")).alias("invalid_records"),
        F.round(F.coalesce(F.try_divide("records_written", "records_read"), F.lit(1.0)), 4).alias("quality_score"),
    )


def dq_score(df: DataFrame, table: str, key: str | None, not_null: Sequence[str] = ()) -> DataFrame:
    """Score 1.0, times 0.9 per column with NULLs, times 0.8 for a repeated key."""
    cols = [c for c in not_null if c in df.columns]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    if key is None or key not in df.columns:
        one = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls).withColumn("duplicate_keys", F.lit(0).cast("long"))
    else:
        # count per key first: no task ever holds the whole set of keys
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *nulls)
        one = per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in cols],
            (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_keys"),
        )
    score = F.when(F.col("duplicate_keys") > 0, 0.8).otherwise(1.0)
    for c in cols:
        score = score * F.when(F.col(f"null_{c}") > 0, 0.9).otherwise(1.0)
    return one.select(
        F.lit(table).alias("table_name"), "*", (F.col("row_count") == 0).alias("is_empty"), F.round(score, 6).alias("quality_score")
    )


def gate(report: DataFrame, minimum: float = 0.8) -> None:
    """Stop the job when a report row falls below ``minimum`` (one row per table is read)."""
    bad = report.filter(F.col("quality_score") < minimum).select("table_name", "quality_score").collect()
    if bad:
        raise ValueError("quality below %s: %s" % (minimum, ", ".join(f"{r[0]}={r[1]}" for r in bad)))


_SAME = {"decimal": "double", "float": "double", "varchar": "string", "char": "string"}


def _family(dtype: T.DataType | str) -> str:
    name = dtype if isinstance(dtype, str) else dtype.typeName()
    name = name.lower().split("(")[0]
    return _SAME.get(name, name)


def contract(
    df: DataFrame, table: str, required: Sequence[str] = (), key: str | None = None, mandatory: Sequence[str] = (),
    types: Mapping[str, str] | None = None, min_rows: int = 1,
) -> DataFrame:
    """One row per assertion: (table_name, assertion, subject, violations, passed)."""
    mandatory = [c for c in mandatory if c in df.columns]
    facts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in mandatory]
    if key:
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *facts)
        row = per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("null_key"),
            F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("dup_key"),
            *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in mandatory],
        )
    else:
        row = df.agg(F.count(F.lit(1)).alias("rows"), *facts)

    def line(assertion: str, subject: str, bad: Column) -> Column:
        return F.struct(F.lit(assertion).alias("assertion"), F.lit(subject).alias("subject"), bad.cast("long").alias("violations"))

    lines = [line("min_rows", str(min_rows), F.greatest(F.lit(min_rows) - F.col("rows"), F.lit(0)))]
    lines += [line("required_column", c, F.lit(int(c not in df.columns))) for c in required]
    if key:
        lines += [line("null_key", key, F.col("null_key")), line("duplicate_key", key, F.col("dup_key"))]
    lines += [line("not_null", c, F.col(f"null_{c}")) for c in mandatory]
    schema = {f.name: _family(f.dataType) for f in df.schema.fields}
    lines += [line("type", c, F.lit(int(schema.get(c) != _family(want)))) for c, want in (types or {}).items()]
    return row.select(F.explode(F.array(*lines)).alias("l")).select(
        F.lit(table).alias("table_name"), "l.*", (F.col("l.violations") == 0).alias("passed")
    )


# ── keys between tables ──────────────────────────────────────────────────


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose non-NULL foreign key has no parent."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def fk_check(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    return orphans(child, fk, parent, pk).agg(F.count(F.lit(1)).alias("orphan_rows")).select(
        F.lit(name).alias("check_name"), "orphan_rows", (F.col("orphan_rows") == 0).alias("passed")
    )


def fk_repair(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Only rows with a parent."""
    return child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_semi").select(*child.columns)


def fk_outcomes(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows with a foreign key, and ``outcome``: kept where the parent is there, else orphan; one join for both."""
    keys = parent.select(F.col(pk).alias(fk)).distinct().withColumn("_there", F.lit(True))
    found = child.filter(F.col(fk).isNotNull()).join(keys, fk, "left")
    return found.select(*child.columns, F.when(F.col("_there"), "kept").otherwise("orphan").alias("outcome"))


def parent_repair(categories: DataFrame, key: str = "category_id", parent: str = "parent_category_id") -> DataFrame:
    """Drop a link to a missing parent, keep the row, and say so."""
    known = categories.select(F.col(key).alias(parent)).distinct().withColumn("_known", F.lit(True))
    joined = categories.join(known, parent, "left")
    broken = F.col(parent).isNotNull() & F.col("_known").isNull()
    return joined.withColumn("broken_parent", F.when(broken, F.col(parent))).withColumn(
        parent, F.when(~broken, F.col(parent))
    ).drop("_known")


def text_readiness(df: DataFrame, col: str) -> DataFrame:
    """Total and blank texts; ready when there is text and none is blank."""
    facts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_blank(F.col(col))).alias("empty"))
    return facts.select("*", ((F.col("total") > 0) & (F.col("empty") == 0)).alias("ready"))


def blank_samples(df: DataFrame, col: str, *shown: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows without a text, by the shown columns; they go with the readiness verdict."""
    return df.filter(is_blank(F.col(col))).select(*shown).orderBy(*[F.col(c).asc_nulls_first() for c in shown]).limit(n)


def require_text(df: DataFrame, col: str = "searchable_text") -> DataFrame:
    """The same rows; the job fails on the first blank text."""
    message = F.lit(f"{col} is blank in the search catalog")
    guarded = F.when(is_blank(F.col(col)), F.raise_error(message).cast("string")).otherwise(F.col(col))
    return df.withColumn(col, guarded)


def query_policy(df: DataFrame, query: str = "query", max_length: int = 512) -> DataFrame:
    """Verdict and reason per query."""
    q = F.col(query)
    empty = F.coalesce(F.regexp_replace(q, r"\s", "") == "", F.lit(True))
    long_reason = F.concat(
        F.lit("Query length ("), F.length(q).cast("string"), F.lit(f") exceeds maximum allowed limit ({max_length} characters).")
    )
    reason = (
        F.when(empty, "Empty search query is rejected.")
        .when(F.length(q) > max_length, long_reason)
        .when(q.rlike(r"""[^\p{L}\p{N}_\s\-.,?!'"]"""), "Query contains unsupported or anomalous characters.")
    )
    return df.select("query_id", reason.isNull().alias("valid"), reason.alias("reason"))


def price_overlap(prices: DataFrame) -> DataFrame:
    """Prices starting before an earlier price of their product has ended.

    Reported with the earlier price that ends last; no end means open. Rows
    without a product or a start are left out. The latest end is carried along
    per product and month, then over the months, so only one product's prices
    of one month are sorted in a task.
    """
    from pyspark.sql import Window

    rows = prices.filter(F.col("product_id").isNotNull() & F.col("effective_from").isNotNull())
    rows = rows.withColumn("_m", F.year("effective_from") * 12 + F.month("effective_from"))
    end = F.struct(F.col("effective_to").isNull().alias("open"), "effective_to", "effective_from", "price_id")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = earlier.partitionBy("product_id", "_m").orderBy("effective_from", "price_id")
    before = earlier.partitionBy("product_id").orderBy("_m")
    here = rows.withColumn("_inside", F.max(end).over(inside))
    months = rows.groupBy("product_id", "_m").agg(F.max(end).alias("_last"))
    carried = months.select("product_id", "_m", F.max("_last").over(before).alias("_carry"))
    return (
        here.join(carried, ["product_id", "_m"])
        .withColumn("_prev", F.greatest("_inside", "_carry"))
        .filter(F.col("_prev.open") | (F.col("_prev.effective_to") > F.col("effective_from")))
        .select(
            "price_id", "product_id", "effective_from",
            F.col("_prev.price_id").alias("previous_price_id"), F.col("_prev.effective_to").alias("previous_to"),
        )
    )


def drop_rate(raw: DataFrame, clean: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows per layer, share dropped, and survival in percent."""
    tagged = raw.select(F.lit("raw").alias("layer")).unionByName(clean.select(F.lit("clean").alias("layer"))).unionByName(
        gold.select(F.lit("gold").alias("layer"))
    )
    n = tagged.agg(*[F.count_if(F.col("layer") == x).alias(f"{x}_records") for x in ("raw", "clean", "gold")])
    lost = F.try_divide(F.col("raw_records") - F.col("clean_records"), F.col("raw_records"))
    return n.select(
        "*", F.round(F.coalesce(lost, F.lit(0.0)), 4).alias("drop_rate"),
        F.round(F.coalesce(F.try_divide(100.0 * F.col("gold_records"), F.col("raw_records")), F.lit(0.0)), 2).alias("survival_pct"),
    )


def text_diversity(df: DataFrame, text: str, keywords: str) -> DataFrame:
    """Share of distinct texts, keyword rows with stopwords, keyword rows with repeats."""
    words = F.transform(F.split(keywords, ","), lambda w: F.trim(w))
    facts = F.struct(
        F.col(keywords).rlike(r"\b(?:and|the|for|with)\b").alias("stop"), (F.size(F.array_distinct(words)) < F.size(words)).alias("rep")
    )
    # texts are told apart by a digest, one row per digest after the map side
    per_text = df.select(F.sha2(F.col(text), 256).alias("h"), facts.alias("f")).groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("f.stop").alias("stop"), F.count_if("f.rep").alias("rep")
    )
    return per_text.agg(
        F.round(F.try_divide(F.count("h"), F.sum("n")), 6).alias("uniqueness"),
        F.sum("stop").alias("stopword_rows"), F.sum("rep").alias("repeated_keyword_rows"),
    )
