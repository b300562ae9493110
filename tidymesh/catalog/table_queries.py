"""Queries of the table verbs and functions."""

from __future__ import annotations

from tidymesh import verbs as tm
from tidymesh.catalog.registry import Tables, query
from tidymesh.verbs import X

Z995 = 2.5758293035489004
Z9975 = 2.807033768343811


# sources


@query("SELECT * FROM (VALUES (1, 'a', 0.5), (2, 'b', 0.5), (3, 'c', 0.5)) t(x, y, z)")
def source_make(t: Tables):
    return tm.df_make(x=[1, 2, 3], y=["a", "b", "c"], z=0.5).selectExpr("CAST(x AS INT) AS x", "y", "CAST(z AS DECIMAL(2,1)) AS z")


@query("SELECT a, b, c FROM (VALUES (1), (2), (3)) u(a), (VALUES ('p'), ('q')) v(b), (VALUES (0.5), (1.5)) w(c)")
def source_grid(t: Tables):
    return tm.df_grid(a=[1, 2, 3], b=["p", "q"], c=[0.5, 1.5]).selectExpr("a", "b", "CAST(c AS DECIMAL(2,1)) AS c")


@query("SELECT * FROM region")
def source_parquet(t: Tables):
    return t("region")


@query("SELECT * FROM nation")
def source_csv_round_trip(t: Tables):
    from tidymesh.plans.storage import shared_dir

    path = f"{shared_dir(t.spark)}/nation-csv"
    t("nation").df.write.mode("overwrite").option("header", True).csv(path)
    return tm.read_csv(path, "n_nationkey INT, n_name STRING, n_regionkey INT")


# projection


@query("SELECT p_partkey, p_name, p_size FROM part")
def select_names(t: Tables):
    return t("part") >> tm.tf_select("p_partkey", X.p_name, "p_size")


@query("SELECT p_retailprice, p_name FROM part")
def select_expressions(t: Tables):
    return t("part") >> tm.tf_select(X.p_retailprice, 1)


@query("SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def select_without(t: Tables):
    return t("part") >> tm.tf_select(~tm.starts_with("p_na"))


@query("SELECT p_name, p_type, p_size FROM part")
def select_selectors(t: Tables):
    return t("part") >> tm.tf_select(tm.ends_with("e")) >> tm.tf_drop(tm.contains("price"))


@query("SELECT p_brand, p_type, p_size, p_retailprice, p_partkey FROM part")
def select_ranges(t: Tables):
    return t("part") >> tm.tf_select(tm.columns_between("p_brand", "p_size"), tm.columns_from("p_size"), tm.columns_to("p_name"))


@query("SELECT l_tax, l_discount, l_quantity FROM lineitem")
def select_matching(t: Tables):
    return t("lineitem") >> tm.tf_select(tm.matches("tax$"), tm.one_of(["l_discount"]), "l_quantity")


@query("SELECT 1 AS x1, 2 AS x2 FROM region")
def select_num_range(t: Tables):
    return t("region") >> tm.tf_mutate(x1=1, x2=2, x9=9) >> tm.tf_select(tm.num_range("x", range(1, 4)))


@query("SELECT * FROM region")
def select_everything(t: Tables):
    return t("region") >> tm.tf_select(tm.everything())


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_columns(t: Tables):
    return t("orders") >> tm.tf_drop("o_totalprice", "o_orderdate", X.o_orderpriority)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_if_numeric(t: Tables):
    return t("customer") >> tm.tf_select_if(tm.is_numeric)


@query("SELECT c_name, c_mktsegment FROM customer")
def drop_if_numeric(t: Tables):
    return t("customer") >> tm.tf_drop_if(tm.is_numeric)


@query("SELECT p_partkey, p_retailprice FROM part")
def select_if_data(t: Tables):
    """Columns whose mean is over 60, all of them tested in one pass."""
    from pyspark.sql import functions as F

    return t("part") >> tm.tf_select("p_partkey", "p_size", "p_retailprice") >> tm.tf_select_if(lambda c: F.avg(c) > 60)


@query("SELECT r_regionkey AS id, r_name AS region FROM region")
def rename(t: Tables):
    return t("region") >> tm.tf_rename(id=X.r_regionkey, region="r_name")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem""")
def mutate(t: Tables):
    return t("lineitem") >> tm.tf_mutate(revenue=X.l_extendedprice * (1 - X.l_discount), charge=X.l_extendedprice * (1 - X.l_discount) * (1 + X.l_tax)) >> tm.tf_select("l_orderkey", "l_linenumber", "revenue", "charge")


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (), 6) AS centred FROM customer")
def mutate_broadcast(t: Tables):
    return t("customer") >> tm.tf_mutate(centred=tm.round(X.c_acctbal - tm.mean(X.c_acctbal), 6)) >> tm.tf_select("c_custkey", "centred")


@query("SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) - l_quantity AS below FROM lineitem")
def mutate_grouped(t: Tables):
    return t("lineitem") >> tm.tf_group_by("l_returnflag", "l_linestatus") >> tm.tf_mutate(below=tm.max(X.l_quantity) - X.l_quantity) >> tm.tf_select("l_orderkey", "l_linenumber", "l_quantity", "below")


@query("SELECT s_suppkey * 2 AS s_suppkey, s_nationkey * 2 AS s_nationkey FROM supplier")
def mutate_if(t: Tables):
    return t("supplier") >> tm.tf_select("s_suppkey", "s_nationkey") >> tm.tf_mutate_if(tm.is_numeric, lambda c: c * 2)


@query("SELECT p_brand FROM part")
def pull(t: Tables):
    return t("part") >> tm.tf_pull("p_brand")


# rows


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07")
def filter_rows(t: Tables):
    return t("lineitem") >> tm.tf_filter(X.l_quantity > 45, tm.between(X.l_discount, 0.05, 0.07, inclusive=True)) >> tm.tf_select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT * FROM customer QUALIFY c_acctbal > avg(c_acctbal) OVER (PARTITION BY c_mktsegment)")
def filter_by_group_mean(t: Tables):
    return t("customer") >> tm.tf_group_by(X.c_mktsegment) >> tm.tf_mask(X.c_acctbal > tm.mean(X.c_acctbal))


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(t: Tables):
    return t("nation") >> tm.tf_filter(tm.var_in(X.n_regionkey, [1, 3])) >> tm.tf_select("n_name")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def drop_missing(t: Tables):
    return t("documents") >> tm.tf_left_join(t("labels"), by="doc_id") >> tm.tf_select("doc_id", "quality") >> tm.tf_dropna()


@query("SELECT count(*) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def filter_missing(t: Tables):
    return t("documents") >> tm.tf_left_join(t("labels"), by="doc_id") >> tm.tf_filter(tm.is_nan(X.quality)) >> tm.tf_summarize(missing=tm.n())


@query("SELECT count(*) AS known FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def filter_known(t: Tables):
    return t("documents") >> tm.tf_left_join(t("labels"), by="doc_id") >> tm.tf_filter(tm.not_nan(X.quality)) >> tm.tf_summarize(known=tm.n())


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t: Tables):
    return t("lineitem") >> tm.tf_select("l_returnflag", "l_linestatus") >> tm.tf_distinct()


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_first(t: Tables):
    return t("events", "event_id") >> tm.tf_distinct("user_id")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def distinct_last(t: Tables):
    return t("events", "event_id") >> tm.tf_distinct(X.user_id, X.event_type, keep="last")


@query("SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def distinct_only_single(t: Tables):
    return t("orders") >> tm.tf_distinct("o_custkey", keep=False)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")
def head(t: Tables):
    return t("orders", "o_orderkey") >> tm.tf_head(7)


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def head_grouped(t: Tables):
    return t("events", "event_id") >> tm.tf_group_by("event_type") >> tm.tf_head(3)


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 6")
def tail(t: Tables):
    return t("orders", "o_orderkey") >> tm.tf_tail(6)


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 2")
def tail_grouped(t: Tables):
    return t("events", "event_id") >> tm.tf_group_by("event_type") >> tm.tf_tail(2)


@query("SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 20)")
def sample_rows(t: Tables):
    return t("customer") >> tm.tf_sample(n=20, random_state=3) >> tm.tf_summarize(n=tm.n())


@query("SELECT c_mktsegment, least(count(*), 5) AS n FROM customer GROUP BY 1")
def sample_grouped(t: Tables):
    return t("customer") >> tm.tf_group_by("c_mktsegment") >> tm.tf_sample(n=5, random_state=3) >> tm.tf_count("c_mktsegment")


@query("SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i IN (0, 3, 10)".replace("SELECT * FROM (", "SELECT * EXCLUDE (i) FROM (", 1))
def row_slice(t: Tables):
    return t("orders", "o_orderkey") >> tm.tf_row_slice([10, 0, 3])


@query("SELECT * FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
def top_n(t: Tables):
    return t("part") >> tm.tf_top_n(10, col="p_size")


@query("SELECT * FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) <= 2")
def top_n_smallest_grouped(t: Tables):
    return t("part") >> tm.tf_group_by("p_brand") >> tm.tf_top_n(2, ascending=False, col=X.p_retailprice)


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def arrange(t: Tables):
    """All rows with the place that the order gives them."""
    return t("supplier") >> tm.tf_arrange(tm.desc(X.s_acctbal), X.s_suppkey) >> tm.tf_mutate(one=1) >> tm.tf_mutate(place=tm.cumsum(X.one)) >> tm.tf_select("s_suppkey", "s_acctbal", "place")


# joins


@query("SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey".replace("o.*,", "o.*, c.c_custkey,"))
def inner_join(t: Tables):
    return t("orders") >> tm.tf_inner_join(t("customer"), by=("o_custkey", "c_custkey"))


@query("SELECT doc_id, count(*) AS n FROM documents d FULL JOIN labels l USING (doc_id) GROUP BY doc_id")
def full_join(t: Tables):
    return t("documents") >> tm.tf_full_join(t("labels"), by="doc_id") >> tm.tf_count("doc_id")


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_join(t: Tables):
    return t("documents") >> tm.tf_select("doc_id", "lang") >> tm.tf_left_join(t("labels"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def right_join(t: Tables):
    """All documents, those without labels too."""
    return t("labels") >> tm.tf_right_join(t("documents"), by="doc_id") >> tm.tf_select("doc_id", "lang", "quality", "toxic")


@query("SELECT a.n_name AS n_name_x, b.n_name AS n_name_y, a.n_regionkey, a.n_nationkey AS n_nationkey_x, b.n_nationkey AS n_nationkey_y FROM nation a FULL JOIN nation b ON a.n_regionkey = b.n_regionkey")
def outer_join_suffixes(t: Tables):
    return t("nation") >> tm.tf_outer_join(t("nation"), by="n_regionkey")


@query("SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def semi_join(t: Tables):
    return t("customer") >> tm.tf_semi_join(t("orders") >> tm.tf_filter(X.o_totalprice > 300000), by=("c_custkey", "o_custkey"))


@query("SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_join(t: Tables):
    return t("customer") >> tm.tf_anti_join(t("orders"), by=("c_custkey", "o_custkey"))


@query("SELECT r_regionkey, r_name, NULL::INT AS n_nationkey, NULL AS n_name FROM region UNION ALL SELECT NULL, NULL, n_nationkey, n_name FROM nation")
def bind_rows(t: Tables):
    return t("region") >> tm.tf_bind_rows(t("nation") >> tm.tf_select("n_nationkey", "n_name"))


@query("SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def bind_rows_inner(t: Tables):
    return t("documents") >> tm.tf_bind_rows(t("labels"), join="inner")


@query("""SELECT a.r_regionkey, a.r_name, b.n_nationkey, b.n_name FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) a
    FULL JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) b USING (i)""")
def bind_cols(t: Tables):
    return t("region", "r_regionkey") >> tm.tf_bind_cols(t("nation", "n_nationkey") >> tm.tf_select("n_nationkey", "n_name"))


@query("SELECT s_suppkey, r_name FROM supplier, region")
def outer_product(t: Tables):
    return t("supplier") >> tm.tf_select("s_suppkey") >> tm.tf_outer(t("region") >> tm.tf_select("r_name"))


# groups and aggregates


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
    round(avg(l_quantity), 8) AS avg_qty, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY ALL""")
def summarize(t: Tables):
    return t("lineitem") >> tm.tf_group_by("l_returnflag", "l_linestatus") >> tm.tf_summarize(
        sum_qty=tm.round(tm.sum(X.l_quantity), 4), revenue=tm.round(tm.sum(X.l_extendedprice * (1 - X.l_discount)), 4), avg_qty=tm.round(tm.mean(X.l_quantity), 8),
        min_price=tm.min(X.l_extendedprice), max_price=tm.max(X.l_extendedprice), n=tm.n(),
    )


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05")
def summarize_whole(t: Tables):
    return t("lineitem") >> tm.tf_filter(X.l_quantity < 24, X.l_discount >= 0.05) >> tm.tf_ungroup() >> tm.tf_summarize(revenue=tm.round(tm.sum(X.l_extendedprice * X.l_discount), 4))


@query("""SELECT o_orderpriority, round(avg(abs(o_totalprice - m)), 4) AS deviation FROM
    (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1""")
def summarize_nested(t: Tables):
    return t("orders") >> tm.tf_group_by("o_orderpriority") >> tm.tf_summarize(deviation=tm.round(tm.mean(tm.abs(X.o_totalprice - tm.mean(X.o_totalprice))), 4))


@query("SELECT p_brand, round(avg(p_size), 8) AS p_size_mean, max(p_size) AS p_size_max, round(avg(p_retailprice), 6) AS p_retailprice_mean, max(p_retailprice) AS p_retailprice_max FROM part GROUP BY 1")
def summarize_each(t: Tables):
    out = t("part") >> tm.tf_group_by("p_brand") >> tm.tf_summarize_each([tm.mean, tm.max], "p_size", "p_retailprice")
    return out >> tm.tf_mutate(p_size_mean=tm.round(X.p_size_mean, 8), p_retailprice_mean=tm.round(X.p_retailprice_mean, 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count(t: Tables):
    return t("events") >> tm.tf_count(X.event_type)


@query("""SELECT * FROM (SELECT 'count' AS statistic, count(p_size)::DOUBLE AS p_size, count(p_retailprice)::DOUBLE AS p_retailprice FROM part
    UNION ALL SELECT 'mean', avg(p_size), round(avg(p_retailprice), 6) FROM part UNION ALL SELECT 'std', round(stddev_samp(p_size), 8), round(stddev_samp(p_retailprice), 6) FROM part
    UNION ALL SELECT 'min', min(p_size), min(p_retailprice) FROM part UNION ALL SELECT 'max', max(p_size), max(p_retailprice) FROM part
    UNION ALL SELECT '25%', quantile_cont(p_size, 0.25), round(quantile_cont(p_retailprice, 0.25), 6) FROM part
    UNION ALL SELECT '50%', quantile_cont(p_size, 0.5), round(quantile_cont(p_retailprice, 0.5), 6) FROM part
    UNION ALL SELECT '75%', quantile_cont(p_size, 0.75), round(quantile_cont(p_retailprice, 0.75), 6) FROM part)""".replace("avg(p_size)", "round(avg(p_size), 8)"))
def describe(t: Tables):
    return t("part") >> tm.tf_select("p_size", "p_retailprice") >> tm.tf_describe() >> tm.tf_mutate(p_size=tm.round(X.p_size, 8), p_retailprice=tm.round(X.p_retailprice, 6))


@query("""SELECT l_returnflag, round(median(l_extendedprice), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90,
    round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr, round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 8) AS s FROM lineitem GROUP BY 1""")
def aggregate_spread(t: Tables):
    return t("lineitem") >> tm.tf_group_by("l_returnflag") >> tm.tf_summarize(
        med=tm.round(tm.median(X.l_extendedprice), 6), q90=tm.round(tm.quant(X.l_extendedprice, p=0.9), 6), iqr=tm.round(tm.IQR(X.l_extendedprice), 6), v=tm.round(tm.var(X.l_quantity), 6), s=tm.round(tm.sd(X.l_quantity), 8)
    )


@query("""WITH m AS (SELECT c_mktsegment AS g, c_acctbal AS x, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer),
    a AS (SELECT g, count(*)::DOUBLE AS n, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM m GROUP BY g)
    SELECT g AS c_mktsegment, round(m3 / m2 ** 1.5, 8) AS skew, round(m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2), 8) AS skew_g1, round(m4 / m2 ** 2, 8) AS kurt, round(m4 / m2 ** 2 - 3, 8) AS excess FROM a""")
def aggregate_shape(t: Tables):
    x = X.c_acctbal
    return t("customer") >> tm.tf_group_by("c_mktsegment") >> tm.tf_summarize(skew=tm.round(tm.skew(x), 8), skew_g1=tm.round(tm.skew(x, bias=False), 8), kurt=tm.round(tm.kurt(x), 8), excess=tm.round(tm.kurt(x, excess=True), 8))


@query("""SELECT event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(CASE WHEN r = 3 THEN value END) AS third, max(CASE WHEN b = 2 THEN value END) AS before_last FROM
    (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS b FROM events) GROUP BY 1""")
def aggregate_positions(t: Tables):
    return t("events", "event_id") >> tm.tf_group_by("event_type") >> tm.tf_summarize(first=tm.first(X.value), last=tm.last(X.value, X.event_id), third=tm.nth(X.value, 2), before_last=tm.nth(X.value, -2))


@query("SELECT d.lang, count(*) AS n, count(DISTINCT quality) + max((quality IS NULL)::INT) AS kinds FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def aggregate_distinct(t: Tables):
    return t("documents") >> tm.tf_left_join(t("labels"), by="doc_id") >> tm.tf_group_by("lang") >> tm.tf_summarize(n=tm.n(), kinds=tm.n_distinct(X.quality))


@query(f"SELECT l_returnflag, round(avg(l_quantity) - {Z995} * stddev_samp(l_quantity) / sqrt(count(*)), 8) AS lo, round(avg(l_quantity) + {Z995} * stddev_samp(l_quantity) / sqrt(count(*)), 8) AS up FROM lineitem GROUP BY 1")
def interval_mean(t: Tables):
    return t("lineitem") >> tm.tf_group_by("l_returnflag") >> tm.tf_summarize(lo=tm.round(tm.mean_lo(X.l_quantity), 8), up=tm.round(tm.mean_up(X.l_quantity), 8))


@query(f"""WITH a AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum((l_quantity > 40)::INT)::DOUBLE AS k, {Z9975} AS z, 1.959963984540054 AS w FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(k / n, 10) AS pr, round((k + z * z / 2) / (n + z * z) - z / (n + z * z) * sqrt(k * (n - k) / n + z * z / 4), 8) AS lo,
    round((k + z * z / 2) / (n + z * z) + z / (n + z * z) * sqrt(k * (n - k) / n + z * z / 4), 8) AS up,
    round((k + w * w / 2) / (n + w * w) - w / (n + w * w) * sqrt(k * (n - k) / n + w * w / 4), 8) AS ci_lo FROM a""")
def interval_probability(t: Tables):
    hit = X.l_quantity > 40
    return t("lineitem") >> tm.tf_group_by("l_returnflag") >> tm.tf_summarize(pr=tm.round(tm.pr(hit), 10), lo=tm.round(tm.pr_lo(hit), 8), up=tm.round(tm.pr_up(hit), 8), ci_lo=tm.round(tm.binomial_ci(hit).lo, 8))


@query("""WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
    SELECT g AS l_returnflag, round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM r GROUP BY 1""")
def correlation(t: Tables):
    x, y = X.l_quantity, X.l_extendedprice
    return t("lineitem") >> tm.tf_group_by("l_returnflag") >> tm.tf_summarize(pearson=tm.round(tm.corr(x, y), 8), spearman=tm.round(tm.corr(x, y, method="spearman"), 8))


@query("""WITH a AS (SELECT l_returnflag AS g, l_quantity * 1500.0 AS p, l_extendedprice AS m FROM lineitem),
    s AS (SELECT g, avg(abs(p - m)) AS mad, quantile_cont(abs(p - m), 0.5) AS mead, avg((p - m) ** 2) AS mse, avg(((p - m) / m) ** 2) AS rel_mse, 1 - sum((m - p) ** 2) / (var_pop(m) * count(m)) AS rsq FROM a GROUP BY 1)
    SELECT g AS l_returnflag, round(mad, 4) AS mad, round(mead, 4) AS mead, round(mse, 0) AS mse, round(sqrt(mse), 4) AS rmse, round(rel_mse, 6) AS rel_mse, round(rsq, 8) AS rsq, round(sqrt(greatest(1 - rsq, 0)), 8) AS ndme FROM s""")
def prediction_errors(t: Tables):
    p, m = X.l_quantity * 1500.0, X.l_extendedprice
    return t("lineitem") >> tm.tf_group_by("l_returnflag") >> tm.tf_summarize(
        mad=tm.round(tm.mad(p, m), 4), mead=tm.round(tm.mead(p, m), 4), mse=tm.round(tm.mse(p, m), 0), rmse=tm.round(tm.rmse(p, m), 4), rel_mse=tm.round(tm.rel_mse(p, m), 6), rsq=tm.round(tm.rsq(p, m), 8), ndme=tm.round(tm.ndme(p, m), 8)
    )


def _pint_sql() -> str:
    return """WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
    k AS (SELECT g, any_value(n) AS n, CAST(ceil((any_value(n) + 1) * 0.05 - 1e-9) AS BIGINT) AS lo, CAST(ceil((any_value(n) + 1) * 0.95 - 1e-9) AS BIGINT) AS up FROM v GROUP BY g)
    SELECT v.g AS o_orderpriority, max(CASE WHEN r = lo - 1 THEN x END) AS lo, max(CASE WHEN r = up THEN x END) AS up FROM v JOIN k ON v.g = k.g GROUP BY 1"""


@query(_pint_sql())
def interval_prediction(t: Tables):
    """One new value lies below the k-th of n with chance k / (n + 1), so the indices are those of 5 and 95 percent."""
    return t("orders") >> tm.tf_group_by("o_orderpriority") >> tm.tf_summarize(lo=tm.pint_lo(X.o_totalprice, alpha=0.05), up=tm.pint_up(X.o_totalprice, alpha=0.05))


@query("SELECT l_returnflag, round(count(*) * avg(l_quantity) ** 2 / avg(l_quantity * l_quantity), 6) AS neff FROM lineitem GROUP BY 1")
def effective_size(t: Tables):
    return t("lineitem") >> tm.tf_group_by("l_returnflag") >> tm.tf_summarize(neff=tm.round(tm.neff_is(X.l_quantity), 6))


# windows


@query("SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_shift(t: Tables):
    return t("events", "event_id") >> tm.tf_group_by("user_id") >> tm.tf_mutate(before=tm.lag(X.value), after=tm.lead(X.value, 2)) >> tm.tf_select("event_id", "before", "after")


@query("""SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size)::DOUBLE AS dense, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)::DOUBLE AS low, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS pct,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::DOUBLE AS num FROM part""")
def window_ranks(t: Tables):
    return t("part", "p_partkey") >> tm.tf_group_by("p_brand") >> tm.tf_mutate(dense=tm.dense_rank(X.p_size), low=tm.min_rank(X.p_size, ascending=False), pct=tm.percent_rank(X.p_size), num=tm.row_number(X.p_size)) >> tm.tf_select("p_partkey", "dense", "low", "pct", "num")


@query("""SELECT event_id, round(sum(value) OVER w, 6) AS s, round(avg(value) OVER w, 8) AS m, round(stddev_samp(value) OVER w, 6) AS d, max(value) OVER w AS hi, min(value) OVER w AS lo,
    bool_or(value > 50) OVER w AS some, bool_and(value > 50) OVER w AS every FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def window_running(t: Tables):
    v = X.value
    return t("events", "event_id") >> tm.tf_group_by("user_id") >> tm.tf_mutate(
        s=tm.round(tm.cumsum(v), 6), m=tm.round(tm.cummean(v), 8), d=tm.round(tm.cumsd(v), 6), hi=tm.cummax(v), lo=tm.cummin(v), some=tm.cumany(v > 50), every=tm.cumall(v > 50)
    ) >> tm.tf_select("event_id", "s", "m", "d", "hi", "lo", "some", "every")


@query("SELECT n_nationkey, round(product(1 + n_nationkey / 100.0) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING), 10) AS p FROM nation")
def window_product(t: Tables):
    return t("nation", "n_nationkey") >> tm.tf_group_by("n_regionkey") >> tm.tf_mutate(p=tm.round(tm.cumprod(1 + X.n_nationkey / 100.0), 10)) >> tm.tf_select("n_nationkey", "p")


@query("""WITH r AS (SELECT *, sum((value <= 40)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
    SELECT event_id, value > 40 AND sum((value > 40)::INT) OVER (PARTITION BY user_id, run) >= 3 AS inrun FROM r""")
def window_consecutive(t: Tables):
    return t("events", "event_id") >> tm.tf_group_by("user_id") >> tm.tf_mutate(inrun=tm.consec(X.value > 40, i=3)) >> tm.tf_select("event_id", "inrun")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def window_fill(t: Tables):
    kept = tm.if_else(X.event_type == "purchase", X.value, None)
    return t("events", "event_id") >> tm.tf_group_by("user_id") >> tm.tf_mutate(seen=tm.fillna(kept, method="ffill")) >> tm.tf_select("event_id", "seen")


@query("""SELECT p_partkey, NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND b.p_partkey <> a.p_partkey) AS best FROM part a""")
def pareto_two_costs(t: Tables):
    return t("part") >> tm.tf_mutate(best=tm.pareto_min(X.p_size, X.p_retailprice)) >> tm.tf_select("p_partkey", "best")


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1), o AS (SELECT p_brand, dense_rank() OVER (ORDER BY m, p_brand)::INTEGER AS place FROM m)
    SELECT p_partkey, place FROM part JOIN o USING (p_brand)""")
def factor_reorder(t: Tables):
    return t("part") >> tm.tf_mutate(place=tm.fct_reorder(X.p_brand, X.p_retailprice)) >> tm.tf_select("p_partkey", "place")


# scalars


@query("""SELECT s_suppkey, abs(s_acctbal) AS a, round(sin(s_suppkey), 8) AS s, round(cos(s_suppkey), 8) AS c, round(tan(s_suppkey), 6) AS t, round(ln(s_suppkey), 8) AS l, round(exp(s_nationkey / 10.0), 6) AS e,
    round(sqrt(s_suppkey), 8) AS r, round(pow(s_suppkey, 1.5), 6) AS p, floor(s_acctbal) AS f, ceil(s_acctbal) AS u, round_even(s_suppkey / 2.0, 0) AS h FROM supplier""")
def math_functions(t: Tables):
    k, b = X.s_suppkey, X.s_acctbal
    return t("supplier") >> tm.tf_mutate(
        a=tm.abs(b), s=tm.round(tm.sin(k), 8), c=tm.round(tm.cos(k), 8), t=tm.round(tm.tan(k), 6), l=tm.round(tm.log(k), 8), e=tm.round(tm.exp(X.s_nationkey / 10.0), 6),
        r=tm.round(tm.sqrt(k), 8), p=tm.round(tm.pow(k, 1.5), 6), f=tm.floor(b), u=tm.ceil(b), h=tm.round(k / 2.0),
    ) >> tm.tf_select("s_suppkey", "a", "s", "c", "t", "l", "e", "r", "p", "f", "u", "h")


@query("""SELECT s_suppkey, trunc(s_acctbal)::BIGINT AS i, s_nationkey::DOUBLE AS f, s_suppkey::VARCHAR AS s, TRY_CAST(substr(s_name, 10) AS DOUBLE) AS n, TRY_CAST(s_name AS DOUBLE) AS none,
    CASE WHEN s_nationkey IN (1, 2, 3) THEN s_nationkey::VARCHAR END AS factor FROM supplier""")
def casts(t: Tables):
    return t("supplier") >> tm.tf_mutate(
        i=tm.as_int(X.s_acctbal), f=tm.as_float(X.s_nationkey), s=tm.as_str(X.s_suppkey), n=tm.as_numeric(tm.str_sub(X.s_name, 9)), none=tm.as_numeric(X.s_name), factor=tm.as_factor(X.s_nationkey, [1, 2, 3])
    ) >> tm.tf_select("s_suppkey", "i", "f", "s", "n", "none", "factor")


@query("SELECT c_custkey, round(exp(-x * x / 2) / sqrt(2 * pi()), 10) AS d FROM (SELECT c_custkey, c_acctbal / 4000 AS x FROM customer)")
def normal_density(t: Tables):
    return t("customer") >> tm.tf_mutate(d=tm.round(tm.dnorm(X.c_acctbal / 4000), 10)) >> tm.tf_select("c_custkey", "d")


@query("SELECT count(*) AS n, 0::BIGINT AS wrong FROM part")
def normal_round_trip(t: Tables):
    p = (X.p_partkey % 997 + 0.5) / 998
    return t("part") >> tm.tf_mutate(e=tm.abs(tm.pnorm(tm.qnorm(p)) - p) > 1e-12) >> tm.tf_summarize(n=tm.n(), wrong=tm.sum(tm.if_else(X.e, 1, 0)))


@query("""SELECT doc_id, coalesce(quality, toxic, -1) AS first, CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'toxic' END AS kind, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS size,
    CASE WHEN lang NOT IN ('en', 'de') THEN lang END AS lang, coalesce(quality, 9) AS filled FROM documents LEFT JOIN labels USING (doc_id)""")
def conditions(t: Tables):
    return t("documents") >> tm.tf_left_join(t("labels"), by="doc_id") >> tm.tf_mutate(
        first=tm.coalesce(X.quality, X.toxic, -1), kind=tm.case_when([X.quality == 0, "low"], [X.toxic == 1, "toxic"]), size=tm.if_else(X.n_chars > 500, "long", "short"),
        lang=tm.na_if(X.lang, "en", "de"), filled=tm.fillna(X.quality, 9),
    ) >> tm.tf_select("doc_id", "first", "kind", "size", "lang", "filled")


@query("SELECT n_nationkey, round(1 + 9 * (row_number() OVER (ORDER BY n_nationkey) - 1) / 24.0, 10) AS lin, round(10 ** (2.0 * (row_number() OVER (ORDER BY n_nationkey) - 1) / 24.0), 8) AS log FROM nation")
def spaced_numbers(t: Tables):
    return t("nation", "n_nationkey") >> tm.tf_mutate(lin=tm.round(tm.linspace(1, 10, 25), 10), log=tm.round(tm.logspace(0, 2, 25), 8)) >> tm.tf_select("n_nationkey", "lin", "log")


# strings


@query(r"""SELECT p_partkey, p_brand || '-' || p_size AS c, regexp_matches(p_type, '(STEEL|BRASS)') AS d, len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS n, p_name[2:4] AS s, p_name[-3:] AS e,
    regexp_extract(p_name, '[a-z]+') AS x, regexp_replace(p_name, '[aeiou]', '_') AS r1, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS ra, lower(p_brand) AS lo, upper(p_name) AS up, regexp_replace(p_name, '\s+', '_', 'g') AS snake FROM part""")
def string_functions(t: Tables):
    p = X.p_name
    return t("part") >> tm.tf_mutate(
        c=tm.str_c(X.p_brand, X.p_size, sep="-"), d=tm.str_detect(X.p_type, "(STEEL|BRASS)"), n=tm.str_count(p, "[aeiou]"), s=tm.str_sub(p, 1, 4), e=tm.str_sub(p, -3), x=tm.str_extract(p, "[a-z]+"),
        r1=tm.str_replace(p, "[aeiou]", "_"), ra=tm.str_replace_all(p, "([aeiou])", r"<\1>"), lo=tm.str_to_lower(X.p_brand), up=tm.str_to_upper(p), snake=tm.str_to_snake(p),
    ) >> tm.tf_select("p_partkey", "c", "d", "n", "s", "e", "x", "r1", "ra", "lo", "up", "snake")


@query("""SELECT p_partkey, (nullif(strpos(p_name, 'a'), 0) - 1)::INTEGER AS first, array_to_string(list_transform(list_filter(range(1, len(p_name) + 1), lambda i: p_name[i] = 'a'), lambda i: i - 1), ',') AS places,
    string_split(p_name, ' ')[1] AS word, len(string_split(p_name, ' '))::INTEGER AS words FROM part""")
def string_places(t: Tables):
    from pyspark.sql import functions as F

    from tidymesh.expr import scalar

    spelled, size = scalar(lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))), scalar(F.size)
    return t("part") >> tm.tf_mutate(first=tm.str_which(X.p_name, "a"), places=spelled(tm.str_locate(X.p_name, "a")), word=tm.str_split(X.p_name, " ")[0], words=size(tm.str_split(X.p_name, " "))) >> tm.tf_select(
        "p_partkey", "first", "places", "word", "words"
    )


# shapes


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE value")
def gather(t: Tables):
    return t("lineitem") >> tm.tf_select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax") >> tm.tf_gather("measure", "value", "l_quantity", "l_discount", "l_tax")


@query("SELECT l_returnflag, coalesce(max(CASE WHEN l_linestatus = 'F' THEN n END), 0) AS \"F\", coalesce(max(CASE WHEN l_linestatus = 'O' THEN n END), 0) AS \"O\" FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def spread(t: Tables):
    return t("lineitem") >> tm.tf_count("l_returnflag", "l_linestatus") >> tm.tf_spread("l_linestatus", "n", fill=0)


@query("SELECT c_custkey, string_split(c_name, '#')[1] AS kind, string_split(c_name, '#')[2]::BIGINT AS number FROM customer")
def separate(t: Tables):
    return t("customer") >> tm.tf_separate("c_name", ["kind", "number"], sep="#", convert=True) >> tm.tf_select("c_custkey", "kind", "number")


@query("SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS what FROM orders")
def unite(t: Tables):
    return t("orders") >> tm.tf_unite("what", "o_orderstatus", "o_orderpriority", sep="/") >> tm.tf_select("o_orderkey", "what")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode(t: Tables):
    return t("part") >> tm.tf_mutate(word=tm.str_split(X.p_name, " ")) >> tm.tf_explode("word") >> tm.tf_select("p_partkey", "word")


@query("SELECT l_returnflag, split_part(name, '_', 2) AS measure, value FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME name VALUE value)")
def pivot_longer(t: Tables):
    return t("lineitem") >> tm.tf_select("l_returnflag", "l_quantity", "l_tax") >> tm.tf_pivot_longer(["l_quantity", "l_tax"], names_to=["table", "measure"], names_sep="_", values_to="value") >> tm.tf_drop("table")


@query("SELECT r_regionkey, '1' AS time, r_regionkey + 1 AS a, r_regionkey + 3 AS b FROM region UNION ALL SELECT r_regionkey, '2', r_regionkey + 2, r_regionkey + 4 FROM region")
def pivot_longer_values(t: Tables):
    k = X.r_regionkey
    return t("region") >> tm.tf_mutate(a_1=k + 1, a_2=k + 2, b_1=k + 3, b_2=k + 4) >> tm.tf_drop("r_name") >> tm.tf_pivot_longer(tm.matches("^[ab]_"), names_to=[".value", "time"], names_pattern="(.)_(.)")


@query("PIVOT (SELECT event_type, user_id % 5 AS k, count(*) AS n FROM events GROUP BY ALL) ON k IN (0, 1, 2, 3, 4) USING max(n) GROUP BY event_type")
def pivot_wider(t: Tables):
    return t("events") >> tm.tf_mutate(k=X.user_id % 5) >> tm.tf_count("event_type", "k") >> tm.tf_pivot_wider(names_from="k", indexes_from="event_type", values_from="n")


# sets


@query("SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region")
def set_union(t: Tables):
    return t("nation") >> tm.tf_select("n_regionkey") >> tm.tf_union(t("region") >> tm.tf_rename(n_regionkey="r_regionkey") >> tm.tf_select("n_regionkey"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(t: Tables):
    return t("documents") >> tm.tf_select("doc_id") >> tm.tf_intersect(t("labels") >> tm.tf_select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t: Tables):
    return t("documents") >> tm.tf_select("doc_id") >> tm.tf_set_diff(t("labels") >> tm.tf_select("doc_id"))
