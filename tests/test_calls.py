"""Calls with their arguments, and facts of lines that are joined with their orders once."""

from catalog.facts import FACT_SQL, TABLES, LazyFacts
from fleetscope.functions.runtime import written
from fleetscope.operators import dependencies

CALL = "app_id long, invocation_key string, project string, callee string, receiver_type string, receiver_package string, root_method string, profile string, seq long"
ARG = "app_id long, seq long, invocation_key string, arg_order int, arg_name string, arg_value string"
WEB = "org.springframework.web.client"


def _calls(spark):
    rows = [
        (1, "a", "p", "exchange", "RestTemplate", WEB, "m()", "COMPILE", 1),
        (1, "a", "p", "exchange", "RestTemplate", WEB, "m()", "COMPILE", 2),
        (2, "a", "p", "convertAndSend", "Some", "com", "m()", "COMPILE", 3),
        (1, "b", "p", "other", "Some", "com", "m()", "COMPILE", 4),
        (1, None, "p", "exchange", "RestTemplate", WEB, "m()", "COMPILE", 5),
        (1, "c", "p", None, None, None, "m()", "COMPILE", 6),
    ]
    args = [
        (1, 1, "a", 1, "-", "http://svc-1:80/x"), (1, 1, "a", 1, "-", "http://svc-0:80/x"),
        (1, 2, "a", 2, "HttpMethod.POST", "-"), (1, 3, "a", 3, "-", "-"),
        (2, 1, "a", 1, "-", "NOT_AVAILABLE"), (2, 2, "a", 2, "-", '"q.*"'),
        (1, 1, "b", 1, "-", "http://svc-9:80/x"), (1, 1, None, 1, "-", "http://svc-8:80/x"),
    ]
    return spark.createDataFrame(rows, CALL), spark.createDataFrame(args, ARG)


def test_wanted_calls_meet_the_largest_of_their_arguments(spark):
    found = dependencies.calls_with_args(*_calls(spark), dependencies.EXCHANGE_OR_SEND)
    picked = found.select("app_id", "invocation_key", "seq", "arg_count", "url", "verb_name", "key_text").collect()
    assert sorted(map(tuple, picked), key=repr) == [
        (1, "a", 1, 4, "http://svc-1:80/x", "HttpMethod.POST", "-"),
        (1, "a", 2, 4, "http://svc-1:80/x", "HttpMethod.POST", "-"),
        (2, "a", 3, 2, "NOT_AVAILABLE", "-", '"q.*"'),
    ]


def test_stored_calls_give_the_rows_of_both_rules(spark):
    calls, args = _calls(spark)
    queues = spark.createDataFrame([(2, "svc-7", "q.events")], "app_id long, service string, queue string")
    both = written(dependencies.calls_with_args(calls, args, dependencies.EXCHANGE_OR_SEND))
    for alone, shared in (
        (dependencies.from_rest_template(calls, args), dependencies.rest_template_rows(both.where(dependencies.EXCHANGE))),
        (dependencies.from_async(calls, args, queues), dependencies.async_rows(both.where(dependencies.SEND), queues)),
    ):
        rows = sorted(map(tuple, alone.collect()), key=repr)
        assert rows and rows == sorted(map(tuple, shared.collect()), key=repr)


def _tables(spark, folder):
    made = {
        "supplier": spark.sql("SELECT id AS s_suppkey, 1.0D AS s_acctbal FROM range(10)"),
        "orders": spark.sql(
            "SELECT * FROM VALUES (1L, 3L, 'F', 7.0D), (1L, 4L, 'O', 8.0D), (2L, NULL, 'O', 9.0D), (NULL, 5L, 'F', 9.0D) "
            "o(o_orderkey, o_custkey, o_orderstatus, o_totalprice)"
        ),
        "lineitem": spark.sql(
            "SELECT * FROM VALUES (1L, 1L, 5L, 1L, 2.0D, 'A', 'F'), (1L, 1L, 5L, 1L, 2.0D, 'A', 'F'), (1L, 2L, 6L, 2L, 3.0D, 'N', 'F'), "
            "(2L, NULL, 7L, 3L, 4.0D, NULL, 'O'), (3L, 1L, 8L, 4L, 5.0D, 'R', 'O'), (NULL, 1L, 9L, 5L, 6.0D, 'R', 'O') "
            "l(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)"
        ),
        "customer": spark.sql("SELECT id AS c_custkey, 1L AS c_nationkey, 1.0D AS c_acctbal FROM range(3)"),
    }
    for table in TABLES:
        made.get(table, spark.range(1)).write.parquet(f"{folder}/{table}.parquet")


def test_facts_of_shared_lines_are_the_facts(spark, tmp_path):
    _tables(spark, tmp_path)
    alone, shared = LazyFacts(spark, str(tmp_path)), LazyFacts(spark, str(tmp_path))
    shared.share_lines()
    for name in ("java_annotation", "method_param", "java_invocation", "invocation_arg"):
        assert "JOIN orders" not in shared._fact(name) and "JOIN orders" in FACT_SQL[name]
        rows = sorted(map(tuple, getattr(alone, name).collect()), key=repr)
        assert rows and rows == sorted(map(tuple, getattr(shared, name).collect()), key=repr)
        assert getattr(alone, name).dtypes == getattr(shared, name).dtypes
