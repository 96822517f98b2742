import music_store
import pytest

from fleetscope import rules
from fleetscope.functions.runtime import cut_lineage
from fleetscope.plans.derive import derive
from fleetscope.schema import Facts, fact_schema


@pytest.fixture(scope="module")
def derived(spark):
    tables = {
        name: spark.createDataFrame(rows, fact_schema(name)).repartition(3)
        for name, rows in music_store.rows().items()
    }
    return {name: df.cache() for name, df in derive(Facts.of(spark, tables), cut_lineage).items()}


def found(df, *columns, **wanted):
    for column, value in wanted.items():
        df = df.where(df[column] == value)
    return {tuple(row) for row in df.select(*columns).collect()}


def test_counts(derived):
    assert derived["microservice"].count() == 9
    kinds = sorted(row.kind for row in derived["microservice"].collect())
    assert kinds == ["Infrastructure"] * 2 + ["Microservice"] * 7
    component_kinds = [row.kind for row in derived["component"].collect()]
    assert sorted(component_kinds) == ["Client"] * 16 + ["Pattern"] * 10 + ["Server"] * 2
    assert derived["endpoint"].count() == 27
    assert derived["message"].count() == 19
    assert derived["dependency"].count() == 26
    assert derived["queue_listener"].count() == derived["operation"].count() == 0


def test_evidence_count(derived):
    # 194 texts in total; services repeat theirs for their container and their interface.
    counts = {name: df.count() for name, df in derived.items() if name.endswith("_evidence")}
    assert sum(counts.values()) + 2 * counts["microservice_evidence"] == 194


def test_components_of_musicstore(derived):
    got = found(derived["component"], "kind", "category", "technology", "environment", service="musicstore")
    assert got == {
        (rules.CLIENT, rules.PERSISTENCE, "MySQL", "COMPILE"),
        (rules.PATTERN, rules.METRICS_GENERATION, "Actuator", "COMPILE"),
        (rules.CLIENT, rules.TRACING_MONITORING, "Zipkin", "COMPILE"),
        (rules.CLIENT, rules.REGISTRY, "Eureka", "DOCKER"),
        (rules.PATTERN, rules.LOAD_BALANCER, "Ribbon", "DOCKER"),
        (rules.CLIENT, rules.CACHE, "Redis", "DOCKER"),
        (rules.PATTERN, rules.CIRCUIT_BREAKER, "Hystrix", "COMPILE"),
        (rules.PATTERN, rules.BREAKER_GENERATION, "Hystrix", "COMPILE"),
    }


def test_component_evidence_order(derived):
    rows = derived["component_evidence"].where("service = 'musicstore' and technology = 'MySQL'").orderBy("ord")
    names = [row.evidence.split(":")[1].rstrip("]") for row in rows.collect()]
    assert names == [f"mysql.client.{part}" for part in ("username", "password", "server", "database")]
    zipkin = derived["component_evidence"].where("service = 'musicstore' and technology = 'Zipkin'")
    assert zipkin.count() == 4


def test_dependencies_of_musicstore(derived):
    got = found(derived["dependency"], "provider", "destination", "environment", service="musicstore")
    assert got == {
        ("configserver", None, None),
        ("musicservice", None, None),
        ("shoppingcartservice", None, None),
        ("orderservice", None, None),
        ("eurekaserver", "Endpoint[RequestURI:POST /eureka/v2/apps/musicstore]", "DOCKER"),
        ("mysql", "", "DOCKER"),
        ("zipkinserver", "Endpoint[RequestURI:POST /api/v2/spans]", "DOCKER"),
        ("redis", "", "DOCKER"),
    }
    evidence = derived["dependency_evidence"].where("service = 'musicstore'").groupBy("provider").count()
    assert {row.provider: row["count"] for row in evidence.collect()} == {
        "configserver": 2, "musicservice": 2, "shoppingcartservice": 2, "orderservice": 2,
        "eurekaserver": 3, "mysql": 3, "zipkinserver": 2, "redis": 1,
    }


def test_endpoints_and_messages(derived):
    stream = found(derived["endpoint"], "service", "environment", uri="GET /actuator/hystrix.stream")
    assert stream == {("musicstore", "COMPILE")}
    spans = found(derived["message"], "destination", "message_type", service="zipkinserver")
    assert spans == {
        ("GET /api/v2/spans", "RESPONSE"), ("POST /api/v2/spans", "REQUEST"), ("POST /api/v2/spans", "RESPONSE"),
    }
