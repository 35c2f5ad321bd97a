"""Marketplace tables derived from the driver's TPC-H-ish parquet tables.

The derivation is written once, as plain SQL expressions that run unchanged
in Spark SQL and DuckDB (FIXTURES.md). Spark builds each table with
``selectExpr`` over DataFrames (so Catalyst sees one plan from the parquet
scan to the report); the oracle side renders the very same expressions into
``WITH`` clauses. A wrong expression therefore shows up as a mismatch on both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
              "lineitem", "events", "documents", "embeddings", "pages",
              "benchmark", "labels", "conversations")

# Fixed reference instants of the fixtures (FIXTURES.md).
AS_OF = "2001-08-02 00:00:00"          # users, services, orders, ledger
AS_OF_EVENTS = "2024-01-31 00:00:00"   # notifications and limiter attempts

_NOW = "timestamp '2001-08-02 00:00:00'"


@dataclass
class Block:
    """One SELECT of a derived table: a source and one expression per column."""
    source: str                 # key into _SOURCES (how to build the FROM)
    cols: list[tuple[str, str]]
    where: str | None = None
    deps: tuple[str, ...] = field(default=())


def _days_back(col: str, mod: int) -> str:
    return f"{_NOW} - interval '1' day * cast({col} % {mod} as int)"


BLOCKS: dict[str, list[Block]] = {
    "m_categories": [Block("part_types", [
        ("id", "case pt when 'ECONOMY' then 1 when 'SMALL' then 2 when 'MEDIUM' then 3 "
               "when 'LARGE' then 4 when 'PROMO' then 5 else 6 end"),
        ("name", "concat(substring(pt, 1, 1), lower(substring(pt, 2)))"), ("slug", "lower(pt)"),
        ("icon", "concat('icon-', lower(substring(pt, 1, 2)))"),
        ("description", "concat('parts of type ', lower(pt))"),
        ("sort_order", "case pt when 'ECONOMY' then 6 when 'SMALL' then 5 when 'MEDIUM' then 4 "
                       "when 'LARGE' then 3 when 'PROMO' then 2 else 1 end")])],
    "m_users": [
        Block("customer", [
            ("id", "concat('c', cast(c_custkey as string))"),
            ("name", "c_name"),
            ("email", "concat('user', cast(c_custkey as string), '@', case c_custkey % 6 "
                      "when 0 then 'gmail.com' when 1 then 'mail.ru' when 2 then 'yandex.ru' "
                      "when 3 then '123.ru' when 4 then 'corp.example.org' else 'sub.mail.ru' end)"),
            ("role", "'customer'"),
            ("bio", "concat('segment ', c_mktsegment)"),
            ("is_active", "c_acctbal >= 0"),
            ("created_at", _days_back("c_custkey", 400)),
            ("updated_at", _days_back("c_custkey", 60)),
        ]),
        Block("supplier", [
            ("id", "concat('s', cast(s_suppkey as string))"),
            ("name", "s_name"),
            ("email", "concat('pro', cast(s_suppkey as string), '@', case s_suppkey % 3 "
                      "when 0 then 'yandex.ru' when 1 then 'proton.me' else 'studio.example.org' end)"),
            ("role", "'executor'"),
            ("bio", "'executor'"),
            ("is_active", "s_acctbal >= 0"),
            ("created_at", _days_back("s_suppkey", 400)),
            ("updated_at", _days_back("s_suppkey", 60)),
        ]),
        Block("admin_values", [
            ("id", "concat('a', cast(a as string))"),
            ("name", "'Admin'"),
            ("email", "'admin@gmail.com'"),
            ("role", "'admin'"),
            ("bio", "'admin'"),
            ("is_active", "true"),
            ("created_at", "timestamp '1995-01-01 00:00:00'"),
            ("updated_at", "timestamp '1995-01-01 00:00:00'"),
        ]),
    ],
    "m_profiles": [Block("supplier", [
        ("user_id", "concat('s', cast(s_suppkey as string))"),
        ("availability", "case s_suppkey % 8 when 0 then 'busy' when 1 then 'vacation' else 'available' end"),
        ("specialization", "concat('nation ', cast(s_nationkey as string))"),
        ("hourly_rate", "cast(s_suppkey % 50 + 10 as decimal(10,2))"),
        ("response_time", "'< 24 h'"),
        ("languages", "'[\"ru\",\"en\"]'"),
        ("skills", "concat('[{\"name\":\"sql\",\"level\":', cast(s_suppkey % 5 + 1 as string), "
                   "'},{\"name\":\"logo\"}]')"),
        ("portfolio", "'[{\"url\":\"http://x.example/1\",\"title\":\"one\"}]'"),
        ("socials", "case when s_suppkey % 2 = 0 then '{\"website\":\"w\",\"github\":\"g\"}' else '{}' end"),
    ], where="s_suppkey % 4 <> 3")],
    "m_orders": [Block("orders_x_part", [
        ("id", "concat('o', cast(o_orderkey as string))"),
        ("service_id", "concat('p', cast(p_partkey as string))"),
        ("customer_id", "concat('c', cast(o_custkey as string))"),
        ("executor_id", "concat('s', cast(cast(floor(p_partkey / 20) as bigint) as string))"),
        ("status", "case when o_orderstatus = 'F' then 'completed' "
                   "when o_orderstatus = 'O' and o_orderpriority < '3' then 'created' "
                   "when o_orderstatus = 'O' then 'in_progress' "
                   "when o_orderpriority < '3' then 'review' else 'cancelled' end"),
        ("total_price", "cast(o_totalprice as decimal(12,2))"),
        ("deadline_date", "cast(o_orderdate + interval '1' day * p_size as date)"),
        ("requirements", "case when o_orderkey % 4 = 0 then null else concat('priority ', o_orderpriority) end"),
        ("created_at", "o_orderdate"),
        ("updated_at", "o_orderdate + interval '1' day * cast(o_orderkey % 120 as int)"),
    ])],
    "m_reviews": [Block("m_orders", [
        ("id", "concat('r', substring(id, 2))"),
        ("order_id", "id"),
        ("service_id", "service_id"),
        ("customer_id", "customer_id"),
        ("executor_id", "executor_id"),
        ("rating", "cast(1 + cast(substring(id, 2) as bigint) % 5 as int)"),
        ("comment", "case when cast(substring(id, 2) as bigint) % 2 = 0 then 'fine' else null end"),
        ("created_at", "updated_at + interval '1' day"),
    ], where="status = 'completed' and cast(substring(id, 2) as bigint) % 3 <> 0",
        deps=("m_orders",))],
    "m_services": [Block("part_with_counts", [
        ("id", "concat('p', cast(p_partkey as string))"),
        ("executor_id", "concat('s', cast(cast(floor(p_partkey / 20) as bigint) as string))"),
        ("category_id", "case p_type when 'ECONOMY' then 1 when 'SMALL' then 2 when 'MEDIUM' then 3 "
                        "when 'LARGE' then 4 when 'PROMO' then 5 else 6 end"),
        ("title", "concat(p_name, ' ', p_brand)"),
        ("description", "concat('made to order: ', p_name, ', size ', cast(p_size as string))"),
        ("price", "cast(p_retailprice as decimal(12,2))"),
        ("deadline", "p_size"),
        ("is_active", "p_partkey % 11 <> 0"),
        ("tags", "concat('[\"', split_part(p_name, ' ', 1), '\",\"', split_part(p_name, ' ', 2), '\"]')"),
        ("is_negotiable", "p_partkey % 5 = 0"),
        ("rating", "cast(coalesce(ra, 0) as decimal(3,2))"),
        ("reviews_count", "cast(coalesce(rc, 0) as int)"),
        ("orders_count", "cast(coalesce(oc, 0) as int)"),
        ("created_at", "timestamp '2001-08-02 00:00:00' - interval '1' day * cast(p_partkey % 900 as int)"),
    ], deps=("m_orders", "m_reviews"))],
    "m_status_log": [
        Block("m_orders", [
            ("order_id", "id"), ("old_status", "'created'"), ("new_status", "'in_progress'"),
            ("changed_by", "executor_id"), ("created_at", "created_at + interval '1' day"),
        ], where="status in ('in_progress','review','completed')", deps=("m_orders",)),
        Block("m_orders", [
            ("order_id", "id"), ("old_status", "'in_progress'"), ("new_status", "'review'"),
            ("changed_by", "executor_id"), ("created_at", "created_at + interval '2' day"),
        ], where="status in ('review','completed')", deps=("m_orders",)),
        Block("m_orders", [
            ("order_id", "id"), ("old_status", "'review'"), ("new_status", "'completed'"),
            ("changed_by", "customer_id"), ("created_at", "created_at + interval '3' day"),
        ], where="status = 'completed'", deps=("m_orders",)),
        Block("m_orders", [
            ("order_id", "id"), ("old_status", "'created'"), ("new_status", "'cancelled'"),
            ("changed_by", "customer_id"), ("created_at", "created_at + interval '1' day"),
        ], where="status = 'cancelled'", deps=("m_orders",)),
    ],
    "m_messages": [Block("conversations_x_orders", [
        ("id", "concat('m', cast(conv_id as string), '-', cast(turn as string))"),
        ("order_id", "id"),
        ("sender_id", "case role when 'user' then customer_id when 'assistant' then executor_id else 'a0' end"),
        ("message", "text"),
        ("is_read", "turn % 2 = 0"),
        ("created_at", "created_at + interval '1' hour * cast(turn as int)"),
    ], deps=("m_orders",))],
    "m_balances": [
        Block("customer", [
            ("user_id", "concat('c', cast(c_custkey as string))"),
            ("amount", "cast(greatest(c_acctbal, 0.0) as decimal(12,2))"),
        ], where="c_custkey % 10 <> 0"),
        Block("supplier", [
            ("user_id", "concat('s', cast(s_suppkey as string))"),
            ("amount", "cast(greatest(s_acctbal, 0.0) as decimal(12,2))"),
        ], where="s_suppkey % 10 <> 0"),
    ],
    "m_transactions": [Block("lineitem_x_orders", [
        ("id", "concat('t', cast(l_orderkey as string), '-', cast(l_partkey as string), '-', "
               "cast(l_suppkey as string), '-', cast(l_linenumber as string), '-', "
               "cast(cast(l_extendedprice as decimal(12,2)) as string))"),
        ("user_id", "case when l_returnflag = 'A' and l_linenumber % 2 = 0 then executor_id else customer_id end"),
        ("order_id", "case when l_returnflag = 'A' and l_linenumber <= 4 then id else null end"),
        ("type", "case l_returnflag when 'A' then 'deposit' when 'R' then 'payment' else 'withdrawal' end"),
        ("amount", "cast(l_extendedprice as decimal(12,2))"),
        ("created_at", "l_shipdate"),
    ], deps=("m_orders",))],
    "m_notifications": [Block("events", [
        ("id", "concat('n', cast(event_id as string))"),
        ("user_id", "concat('c', cast(user_id as string))"),
        ("type", "event_type"),
        ("title", "concat('event ', event_type)"),
        ("data", "props"),
        ("is_read", "event_id % 3 = 0"),
        ("created_at", "ts"),
    ])],
    "m_attempts": [Block("events", [
        ("attempt_id", "event_id"),
        ("attempt_key", "concat('u', cast(user_id as string))"),
        ("ts", "ts"),
    ])],
    "m_texts": [Block("documents", [
        ("doc_id", "doc_id"),
        ("field", "case doc_id % 3 when 0 then 'title' when 1 then 'message' else 'description' end"),
        ("body", "concat(text, case doc_id % 10 when 0 then ' Aaaaaaaa' when 1 then ' http://x.example/a' "
                 "when 2 then ' Buy CASINO now' when 3 then repeat('я', 60) when 4 then ' яcrypto' "
                 "when 6 then ' https://y.example' else '' end)"),
    ])],

    # ---- request tables (inputs of the change rules, FIXTURES.md section 3) ----
    "m_req_orders": [Block("m_orders", [
        ("request_id", "id"), ("ts", "created_at"), ("customer_id", "customer_id"),
        ("service_id", "service_id"), ("requirements", "requirements"),
    ], deps=("m_orders",))],
    "m_req_status": [
        Block("m_status_log", [
            ("request_id", "concat('q', order_id, '-', new_status)"), ("ts", "created_at"),
            ("order_id", "order_id"), ("actor_id", "changed_by"), ("new_status", "new_status"),
            ("note", "cast(null as string)"),
        ], deps=("m_status_log",)),
        Block("m_status_log", [
            ("request_id", "concat('w', order_id, '-', new_status)"),
            ("ts", "created_at + interval '12' hour"),
            ("order_id", "order_id"), ("actor_id", "changed_by"), ("new_status", "new_status"),
            ("note", "'repeat'"),
        ], deps=("m_status_log",)),
    ],
    "m_req_deposits": [
        Block("m_transactions", [
            ("request_id", "id"), ("ts", "created_at"), ("user_id", "user_id"),
            ("amount", "amount"), ("reason", "'topup'"),
        ], where="type = 'deposit'", deps=("m_transactions",)),
        Block("m_transactions", [
            ("request_id", "concat('d', id)"), ("ts", "created_at"), ("user_id", "user_id"),
            ("amount", "cast(floor(amount * 5) / 100 as decimal(12,2))"), ("reason", "'small'"),
        ], where="type = 'withdrawal'", deps=("m_transactions",)),
    ],
    "m_req_adjust": [Block("m_transactions", [
        ("request_id", "id"), ("ts", "created_at"), ("user_id", "user_id"),
        ("amount", "case when type = 'payment' then -amount else cast(floor(amount * 25) / 100 as decimal(12,2)) end"),
        ("reason", "type"),
    ], where="type in ('payment','withdrawal')", deps=("m_transactions",))],
    "m_req_price": [Block("m_orders", [
        ("request_id", "concat('p', id)"), ("ts", "updated_at"), ("order_id", "id"),
        ("actor_id", "case when cast(substring(id, 2) as bigint) % 2 = 0 then executor_id else customer_id end"),
        ("price", "case when cast(substring(id, 2) as bigint) % 13 = 0 then cast(0 as decimal(12,2)) "
                  "else cast(floor(total_price * 110) / 100 as decimal(12,2)) end"), ("note", "'reprice'"),
    ], deps=("m_orders",)), Block("m_orders", [
        ("request_id", "concat('r', id)"), ("ts", "updated_at + interval '1' hour"), ("order_id", "id"),
        ("actor_id", "executor_id"),
        ("price", "cast(floor(total_price * 90) / 100 as decimal(12,2))"), ("note", "'cheaper'"),
    ], where="cast(substring(id, 2) as bigint) % 3 = 0", deps=("m_orders",))],
    "m_req_reviews": [
        Block("m_orders", [
            ("request_id", "concat('v', id)"), ("ts", "updated_at + interval '2' day"),
            ("customer_id", "customer_id"), ("order_id", "id"),
            ("rating", "cast(1 + cast(substring(id, 2) as bigint) % 6 as int)"),
            ("comment", "case cast(substring(id, 2) as bigint) % 6 when 0 then 'good work' when 1 then ' fine, thanks  ' "
                        "when 2 then '   ' when 3 then concat(repeat(' ', 600), repeat('x', 700)) "
                        "when 4 then repeat('y', 1001) else null end"),
        ], where="status in ('completed','review')", deps=("m_orders",)),
        Block("m_orders", [
            ("request_id", "concat('x', id)"), ("ts", "updated_at + interval '3' day"),
            ("customer_id", "customer_id"), ("order_id", "id"),
            ("rating", "5"), ("comment", "'again'"),
        ], where="status = 'completed' and cast(substring(id, 2) as bigint) % 2 = 0", deps=("m_orders",)),
    ],
    "m_req_messages": [Block("m_messages", [
        ("request_id", "concat('q', id)"), ("ts", "created_at + interval '1' minute"),
        ("order_id", "order_id"), ("sender_id", "sender_id"),
        ("message", "case length(message) % 9 when 0 then concat('  ', message, chr(10)) "
                    "when 1 then concat(chr(9), ' ', chr(10)) when 2 then concat(repeat(' ', 1500), message, ' ') "
                    "when 3 then repeat(concat(message, '.'), 2001) else message end"),
        ("is_admin", "sender_id = 'a0'"),
    ], deps=("m_messages",))],
}

# Never stored: a projection of one stored table whose texts are up to 2001 times the
# stored ones (megabytes), so that a scan's batch of rows would not fit in memory.
_PROJECTED = ("m_req_messages",)

# Derived without storing their source for it (unless it is stored already), as the ledger is
# larger than the requests made from some of its rows, and their filter reaches lineitem;
# ids packed closer (zstd), no shuffle file left behind.
_DIRECT = ("m_req_adjust",)

# FROM clauses as DuckDB text; the Spark side builds the same relation below.
_DUCK_FROM = {
    "part_types": "(select distinct p_type as pt from part) t",
    "admin_values": "(values (0)) as t(a)",
    "orders_x_part": "orders join part on p_partkey = o_orderkey % "
                     "(select cast(floor(count(*) * 0.75) as bigint) from part)",
    "part_with_counts": "part left join (select service_id as os, count(*) as oc from m_orders "
                        "group by service_id) o on os = concat('p', cast(p_partkey as string)) "
                        "left join (select service_id as rs, count(*) as rc, avg(rating) as ra "
                        "from m_reviews group by service_id) r on rs = concat('p', cast(p_partkey as string))",
    "conversations_x_orders": "conversations join m_orders on conv_id = cast(substring(id, 2) as bigint)",
    "lineitem_x_orders": "lineitem join m_orders on l_orderkey = cast(substring(id, 2) as bigint)",
}

# Tables each raw source reads (so the oracle registers only what it needs).
_RAW_OF_SOURCE = {
    "part_types": ("part",),
    "orders_x_part": ("orders", "part"),
    "part_with_counts": ("part",),
    "conversations_x_orders": ("conversations",),
    "lineitem_x_orders": ("lineitem",),
}


def _block_sql(b: Block) -> str:
    src = _DUCK_FROM.get(b.source, b.source)
    cols = ", ".join(f"{expr} AS {name}" for name, expr in b.cols)
    where = f" WHERE {b.where}" if b.where else ""
    return f"SELECT {cols} FROM {src}{where}"


def table_sql(name: str) -> str:
    """The derived table as one SQL statement (UNION ALL of its blocks)."""
    return " UNION ALL ".join(_block_sql(b) for b in BLOCKS[name])


def _closure(names) -> list[str]:
    """Derived tables needed by ``names``, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for b in BLOCKS[n]:
            for d in b.deps:
                visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_clause(names) -> str:
    """``WITH m_x AS MATERIALIZED (...), ...`` for the oracle, dependencies included: each table is derived once."""
    parts = [f"{n} AS MATERIALIZED ({table_sql(n)})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


# --------------------------------------------------------------------------- Spark side


class Tables(dict):
    """Lazily derived fixture tables keyed by their short name (users, orders, ...).

    Each DataFrame is built on first use and memoised, so one query plan
    refers to a single logical subtree per table and Spark can reuse its
    exchange when the same table feeds several branches.
    """

    SHORT = {
        "categories": "m_categories", "users": "m_users", "profiles": "m_profiles",
        "orders": "m_orders", "reviews": "m_reviews", "services": "m_services",
        "status_log": "m_status_log", "messages": "m_messages", "balances": "m_balances",
        "transactions": "m_transactions", "notifications": "m_notifications",
        "attempts": "m_attempts", "texts": "m_texts",
        "req_orders": "m_req_orders", "req_status": "m_req_status", "req_deposits": "m_req_deposits",
        "req_adjust": "m_req_adjust", "req_price": "m_req_price", "req_reviews": "m_req_reviews",
        "req_messages": "m_req_messages",
    }

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], store: str | None = None):
        super().__init__()
        self.spark = spark
        self.raw = raw
        self.store = store

    def __missing__(self, key: str) -> DataFrame:
        name = self.SHORT.get(key, key)
        if name not in BLOCKS:
            raise KeyError(key)
        if self.store and name not in _PROJECTED:
            df = _stored(self.spark, self._path(name), lambda: _build(self, name), name in _DIRECT)
        else:
            df = _build(self, name)
        self[key] = df
        return df

    def _path(self, name: str) -> str:
        import hashlib
        # the definition (with its dependencies) is part of the name: a changed
        # expression never reads a table stored by an older one
        version = hashlib.sha1(with_clause([name]).encode()).hexdigest()[:12]
        return f"{self.store}/{name}-{version}"

    def stored(self, name: str) -> bool:
        """Whether the derived table is there already."""
        return bool(self.store) and _committed(self.spark, self._path(name))


_STORED: dict[str, DataFrame] = {}


def _stored(spark: SparkSession, path: str, build, tight: bool = False) -> DataFrame:
    """Write a derived table once (a committed parquet directory) and scan it.

    The marketplace tables are this engine's inputs; in a deployment they are
    stored tables. Storing the derivation once per input directory gives the
    queries the same shape: column-pruned, filter-pushed parquet scans
    instead of re-running the TPC-H-to-marketplace joins in every plan. The
    derivation plan is only built when the table has to be written.
    """
    df = _STORED.get(path)
    if df is not None:
        return df
    # any other error of reading a stored table is raised
    if not _committed(spark, path):
        from souk.session import shuffles_dropped
        if tight:
            with shuffles_dropped(spark):
                build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        else:
            build().write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    _STORED[path] = df
    return df


def _committed(spark: SparkSession, path: str) -> bool:
    """A commit leaves _SUCCESS (a failed job doesn't)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _input_digest(sf_dir: str) -> str:
    """Identity of an input directory: its path and its files' sizes and times."""
    import hashlib
    import os
    h = hashlib.sha1(sf_dir.encode())
    if os.path.isdir(sf_dir):
        for name in sorted(os.listdir(sf_dir)):
            st = os.stat(os.path.join(sf_dir, name))
            h.update(f"{name}:{st.st_size}:{st.st_mtime_ns}".encode())
    return h.hexdigest()[:16]


def _relation(T: Tables, source: str) -> DataFrame:
    spark, raw = T.spark, T.raw
    if source == "part_types":
        return raw["part"].select(F.col("p_type").alias("pt")).distinct()
    if source == "admin_values":
        return spark.sql(f"SELECT * FROM {_DUCK_FROM['admin_values']}")
    if source == "orders_x_part":
        part = raw["part"]
        # scalar subquery: the modulus is one number computed from part
        n = part.select(F.floor(F.count(F.lit(1)) * F.lit(0.75)).cast("bigint")).scalar()
        return raw["orders"].join(part, F.col("p_partkey") == F.col("o_orderkey") % n)
    if source == "part_with_counts":
        pid = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
        oc = T["orders"].groupBy(F.col("service_id").alias("os")).agg(F.count(F.lit(1)).alias("oc"))
        rc = T["reviews"].groupBy(F.col("service_id").alias("rs")).agg(
            F.count(F.lit(1)).alias("rc"), F.avg("rating").alias("ra"))
        return (raw["part"].join(oc, F.col("os") == pid, "left")
                .join(rc, F.col("rs") == pid, "left"))
    if source in ("conversations_x_orders", "lineitem_x_orders"):
        # ``id = concat('o', cast(k as string))`` holds exactly when the numeric keys are
        # equal (the mapping is injective), so Spark joins on the bigint key and skips
        # building and comparing strings; the m_orders columns are the shared expressions.
        left, k = (raw["conversations"], "conv_id") if source.startswith("conv") else (raw["lineitem"], "l_orderkey")
        mo = _relation(T, "orders_x_part").selectExpr(
            "o_orderkey AS _ok", *[f"{expr} AS {col}" for col, expr in BLOCKS["m_orders"][0].cols])
        return left.join(mo, F.col(k) == F.col("_ok")).drop("_ok")
    if source in RAW_TABLES:
        return raw[source]
    short = {v: k for k, v in Tables.SHORT.items()}.get(source)
    if short is not None:
        return T[short]
    raise KeyError(source)


def _build(T: Tables, name: str) -> DataFrame:
    out = None
    for b in BLOCKS[name]:
        rel = _build(T, b.source) if name in _DIRECT and not T.stored(b.source) else _relation(T, b.source)
        if b.where:
            rel = rel.where(b.where)
        df = rel.selectExpr(*[f"{expr} AS {col}" for col, expr in b.cols])
        out = df if out is None else out.unionByName(df)
    return out


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy readers for the driver tables (nothing is scanned until used)."""

    class _Raw(dict):
        def __missing__(self, key):
            if key not in RAW_TABLES:
                raise KeyError(key)
            df = spark.read.parquet(f"{sf_dir}/{key}.parquet")
            self[key] = df
            return df

    return _Raw()


def fixture_tables(spark: SparkSession, sf_dir: str, store: bool | None = None) -> Tables:
    """The derived tables over ``sf_dir``.

    With ``store`` (default: the session setting ``souk.fixtures.store``, on) each
    derived table but those of ``_PROJECTED`` is written once under the session's checkpoint folder and
    scanned from there; otherwise every plan derives it from the raw tables.
    """
    if store is None:
        store = spark.conf.get("souk.fixtures.store", "true").lower() == "true"
    path = None
    if store:
        from souk.session import checkpoint_dir
        # per application: concurrent sessions never write the same directory
        app = spark.conf.get("spark.app.id", None) or "session"
        path = f"{checkpoint_dir(spark)}/fixtures/{app}/{_input_digest(sf_dir)}"
    return Tables(spark, read_raw(spark, sf_dir), path)
