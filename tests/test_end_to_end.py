import pytest
from pyspark.sql import functions as F

from fleetscope.functions.runtime import cut_lineage
from fleetscope.functions.ordering import METHOD, REST_TEMPLATE, order_key
from fleetscope.operators import build, config, dependencies
from fleetscope.plans.derive import derive
from fleetscope.plans.extract import extract
from fleetscope.sources import export
from fleetscope.sources.files import read_artifacts
from fleetscope.sources.model_file import read_model_files

COMPOSE = """version: '2'
services:
  gateway:
    build: ./gateway
    ports:
      - "80:8080"
    depends_on: [users]
  users:
    build:
      context: ./users/
    expose:
    - 9001
    links:
      - db
      - db
  db:
    image: "mysql:5.7"   # data
    logging:
      driver: json
  broken:
    environment:
      - A=b
"""
POM = "<project><artifactId>{0}</artifactId>{1}<dependencies>{2}</dependencies></project>"
DEP = "<dependency><groupId>g</groupId><artifactId>{0}</artifactId>{1}</dependency>"
USERS = """package com.acme;
import com.acme.User;
@RestController
@RequestMapping("/users")
public class Users {
  @PostMapping("/add")
  public User add(@RequestBody User user) { return user; }
  @RabbitListener(queues = "user.events.in")
  public void listen(User user) { }
}
"""
GATEWAY = """package com.acme;
import org.springframework.web.client.RestTemplate;
import org.springframework.http.HttpMethod;
@EnableZuulProxy
public class Gateway {
  private static final String HOST = "http://users:9001/";
  private RestTemplate rest;
  private Bus bus;
  public void call() {
    rest.exchange(HOST + "users/add", HttpMethod.POST, null, String.class);
    bus.convertAndSend("topic", "user.events.*");
  }
}
"""
FILES = {
    "docker-compose.yml": COMPOSE,
    "users/Dockerfile": "FROM openjdk:8 AS build\nEXPOSE 9002\nFROM jre:8\n",
    "users/pom.xml": POM.format(
        "users", "<parent><artifactId>base</artifactId></parent>",
        DEP.format("spring-boot-starter-actuator", "") + DEP.format("junit", "<scope>test</scope>"),
    ),
    "base/pom.xml": POM.format("base", "", DEP.format("spring-cloud-starter-hystrix", "<scope>runtime</scope>")),
    "gateway/pom.xml": POM.format("gateway", "", DEP.format("spring-cloud-starter-eureka", "") + DEP.format("users", "")),
    "users/src/main/resources/application.yml": "spring:\n  application:\n    name: users\nport: 9001\n"
    "spring.data.mongodb.uri: mongodb://localhost:${port}/x\nserver.contextPath: /${ctx:api}\n",
    "config/users-docker.yml": "mysql.client.server: DB\n",
    "gateway/src/main/resources/application.properties": "zuul.routes.users.path=/u/**\nspring.cloud.config.uri=http://cfg:88/\n",
    "users/src/main/java/Users.java": USERS,
    "gateway/src/main/java/Gateway.java": GATEWAY,
    "gateway/src/test/java/T.java": "class T { }",
}


@pytest.fixture(scope="module")
def recovered(spark):
    files = spark.createDataFrame(
        [("shop", path, content) for path, content in FILES.items()], "app_id string, path string, content string"
    )
    apps = spark.createDataFrame([("shop", "Shop", "/src")], "app_id string, app_name string, package_url string")
    dirs = spark.createDataFrame([("shop", "config")], "app_id string, config_dir string")
    facts, rejected = extract(files, apps, dirs)
    facts = type(facts)(**{name: cut_lineage(df) for name, df in facts.tables().items()})
    return facts, {name: cut_lineage(df) for name, df in derive(facts, cut_lineage).items()}


def test_folder_of_files_gives_the_same_facts(recovered, spark, tmp_path):
    facts, _ = recovered
    for path, content in FILES.items():
        file = tmp_path / "all apps+1%" / "shop" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
    (tmp_path / "all apps+1%" / "note.txt").write_text("of no application")
    files = cut_lineage(read_artifacts(spark, str(tmp_path / "all apps+1%")))
    assert rows(files, "app_id", "path") == {("shop", path) for path in FILES}
    apps = spark.createDataFrame([("shop", "Shop", "/src"), ("none", "a<b", "/src")], "app_id string, app_name string, package_url string")
    dirs = spark.createDataFrame([("shop", "config")], "app_id string, config_dir string")
    again, rejected = extract(files, apps, dirs)
    for name in ("container", "container_port", "container_link", "module", "library", "property", "java_method", "java_invocation"):
        assert rows(getattr(again, name), *getattr(facts, name).columns) == rows(getattr(facts, name), *getattr(facts, name).columns), name
    assert [row.app_id for row in rejected["applications"].collect()] == ["none"]
    assert all(rejected[name].count() == 0 for name in ("build_files", "compose_files", "java_files", "placeholders", "poms"))


def test_chosen_files_and_directories(spark):
    files = spark.createDataFrame(
        [("a", "stack.txt.yml", COMPOSE), ("a", "deep/users/pom.xml", POM.format("users", "", "")), ("a", "compose.yaml", "x"), ("a", "pom.xml", "<no")],
        "app_id string, path string, content string",
    )
    apps = spark.createDataFrame([("a", "A", "/src")], "app_id string, app_name string, package_url string")
    dirs = spark.createDataFrame([], "app_id string, config_dir string")
    chosen = spark.createDataFrame([("a", "stack.txt.yml")], "app_id string, path string")
    modules = spark.createDataFrame([("a", "deep/users")], "app_id string, directory string")
    facts, rejected = extract(files, apps, dirs, chosen, modules)
    assert rows(facts.container, "name") == {("gateway",), ("users",), ("db",)}
    assert rows(facts.module, "artifact_id") == {("users",)}
    assert rows(rejected["poms"], "path") == {("pom.xml",)}
    assert rows(extract(files, apps, dirs)[1]["compose_files"], "path") == {("compose.yaml",)}


def test_deep_placeholders_and_circles(spark):
    chain = [("m", 0, at, f"k{at}", f"${{k{at + 1}}}-" if at < 20 else "end") for at in range(21)]
    others = [
        ("m", 0, 50, "x", "${x2}"), ("m", 0, 51, "x2", "a${x}"), ("m", 1, 52, "y", "${x}${k20}"), ("m", 1, 53, "k20", "near"),
        ("m", 1, 54, "z", "${k19}/${gone}"), ("n", 0, 55, "w", "${k0}"),
    ]
    table = spark.createDataFrame(chain + others, "module string, doc_order int, pos_order int, name string, value string")
    resolved, rejected = config.resolve_placeholders(table, ["module"])
    got = {row.pos_order: row.value for row in resolved.collect()}
    assert got[0] == "end" + "-" * 20 and got[19] == "end-" and len(got) == 27
    assert (got[50], got[51], got[52], got[54], got[55]) == ("${x2}", "a${x}", "${x}${k20}", "near-/${gone}", "${k0}")
    assert {row.pos_order for row in rejected.collect()} == {50, 51, 52}


def test_feign_before_rest_template(spark):
    """One destination asked for by both: the RestTemplate call comes later, whatever the places in the files."""
    columns = "app_id string, service string, provider string, destination string, operation string, environment string, overwrites boolean, from_method boolean, evidence string, ord long"
    feign, rest = order_key(METHOD, F.lit(900)), order_key(REST_TEMPLATE, F.lit(1))
    made = spark.createDataFrame([("a", "s", "p", "d", name, "e", False, True, name, 0) for name in ("feign()", "rest()")], columns)
    made = made.withColumn("ord", F.when(F.col("operation") == "feign()", feign).otherwise(rest))
    assert [row.operation for row in dependencies.merge_dependencies(made).rows.collect()] == ["rest()"]


def rows(df, *columns):
    return {tuple(row) for row in df.select(*columns).collect()}


def test_deployment(recovered):
    facts, _ = recovered
    assert rows(facts.container, "name", "image", "build", "generates_logs") == {
        ("gateway", "", "./gateway", False), ("users", "jre:8", "./users/", False), ("db", "mysql:5.7", "", True),
    }
    assert rows(facts.container_port, "container", "port") == {
        ("gateway", "80:8080"), ("users", "9001"), ("users", "9002"),
    }
    assert rows(facts.container_link, "container", "dep_order", "target") == {("gateway", 1, "users"), ("users", 1, "db")}


def test_build_files(recovered):
    facts, _ = recovered
    assert rows(facts.module, "artifact_id", "kind", "project") == {
        ("users", "SpringMVC", "Shop"), ("gateway", "SpringMVC", "Shop"),
    }
    ordered = facts.library.orderBy("project", "seq")
    assert [tuple(row) for row in ordered.select("project", "library_name", "scope").collect()] == [
        ("gateway", "spring-cloud-starter-eureka", "COMPILE"),
        ("gateway", "spring-cloud-starter-hystrix", "RUNTIME"),
        ("gateway", "spring-boot-starter-actuator", "COMPILE"),
        ("gateway", "junit", "TEST"),
        ("users", "spring-cloud-starter-hystrix", "RUNTIME"),
        ("users", "spring-boot-starter-actuator", "COMPILE"),
        ("users", "junit", "TEST"),
    ]


def test_configuration(recovered):
    facts, _ = recovered
    assert rows(facts.property, "project", "name", "value", "profile") == {
        ("users", "spring.application.name", "users", "COMPILE"),
        ("users", "port", "9001", "COMPILE"),
        ("users", "spring.data.mongodb.uri", "mongodb://users/x", "COMPILE"),
        ("users", "server.contextPath", "/api", "COMPILE"),
        ("users", "mysql.client.server", "DB", "DOCKER"),
        ("gateway", "zuul.routes.users.path", "/u/**", "COMPILE"),
        ("gateway", "spring.cloud.config.uri", "http://cfg:88/", "COMPILE"),
    }


def test_derivation(recovered):
    _, derived = recovered
    assert rows(derived["microservice"], "service", "kind") == {
        ("users", "Functional"), ("gateway", "Infrastructure"), ("db", "Infrastructure"),
    }
    published = rows(derived["endpoint"], "service", "uri")
    assert ("users", "POST /api/users/add") in published
    assert ("gateway", "POST /u/api/users/add") in published
    assert ("users", "GET /api/actuator/hystrix.stream") in published
    assert rows(derived["queue_listener"], "service", "queue", "operation_name") == {("users", "user.events.in", "listen()")}
    edges = rows(derived["dependency"], "service", "provider", "destination", "operation", "wrapped")
    assert ("gateway", "users", "QueueListener[QueueName:user.events.in]", "call()", False) in edges
    assert ("gateway", "users", "Endpoint[RequestURI:POST /users/add]", "call()", False) in edges
    assert ("gateway", "users", "Endpoint[RequestURI:POST /api/users/add]", None, True) in edges
    assert ("users", "db", "", None, False) in edges
    assert rows(derived["operation"], "name", "description") == {
        ("add()", "An operation with name add() that requests object User and responds with object User"),
        ("listen()", "An operation with name listen() that reads object User"),
    }


def test_export(recovered, tmp_path, spark):
    facts, derived = recovered
    export.write_facts(facts, str(tmp_path / "facts"))
    again = export.read_facts(spark, str(tmp_path / "facts"))
    assert rows(again.library, *facts.library.columns) == rows(facts.library, *facts.library.columns)
    export.write_architecture(export.architecture_lines(derived), str(tmp_path / "xml"))
    files = sorted((tmp_path / "xml" / "app_id=shop").glob("*.txt"))
    text = "\n".join(file.read_text() for file in files)
    import xml.etree.ElementTree as tree

    root = tree.fromstring(text.replace("<architecture", '<architecture xmlns:xsi="x"', 1))
    assert len(root.findall("microservices")) == 3
    services = {node.get("MicroserviceName"): node for node in root}
    assert len(services["gateway"].findall("interface/destinations")) == sum(
        row.service == "gateway" for row in derived["endpoint"].collect()
    )
    gateway, users = services["gateway"], services["users"]
    wrapped = [node for node in gateway.findall("dependencies") if node.get("isWrappedByCircuitBreaker") == "true"]
    assert wrapped and all(node.findall("GeneratingPSM") for node in wrapped)
    assert {tuple(sorted(line.text for line in node.findall("GeneratingPSM"))) for node in wrapped} == {
        tuple(sorted(line.text for line in gateway.findall("GeneratingPSM")))
    }
    add = next(node for node in users.findall("interface/destinations") if node.get("RequestURI") == "POST /api/users/add")
    assert [node.get("MessageType") for node in add.findall("messages")] == ["REQUEST", "RESPONSE"]
    assert [node.get("OperationName") for node in add.findall("operation")] == ["add()"]
    assert [child.tag for child in add] == ["messages", "messages", "operation", "GeneratingPSM"]
    elements = ("components", "interface/destinations", "dependencies", "container", "interface")
    assert all(node.findall("GeneratingPSM") for one in root.findall("microservices") for kind in elements for node in one.findall(kind))
    assert [line.text for line in root.findall("GeneratingPSM")][0].startswith("DistributedApplicationProject")
    # The first category is the default and is left out.
    assert [node.get("Category") for node in services["gateway"].findall("components") if node.get("Technology") == "Zuul"] == [None]


def test_circles_are_rejected(spark):
    poms = spark.createDataFrame(
        [("a", "x/pom.xml", "x", "y"), ("a", "y/pom.xml", "y", "x"), ("a", "z/pom.xml", "z", None)],
        "app_id string, path string, artifact_id string, parent_artifact_id string",
    )
    deps = spark.createDataFrame(
        [("a", "z/pom.xml", 0, "g", "lib", "COMPILE")],
        "app_id string, path string, pos int, group_name string, library_name string, scope string",
    )
    occurrences, rejected = build.library_occurrences(poms, deps)
    assert rows(rejected, "path", "child") == {("x/pom.xml", "x/pom.xml"), ("y/pom.xml", "y/pom.xml")}
    assert rows(occurrences, "path", "library_name") == {("z/pom.xml", "lib")}


def test_model_file(spark, tmp_path):
    (tmp_path / "m.xmi").write_text(
        '<r><application ApplicationName="A" ProjectPackageURL="/p"><application_project ParentProjectName="A" '
        'ProjectArtifactId="A" ArtifactFileName=""><modules ParentProjectName="A" ProjectArtifactId="m">'
        '<properties FullyQualifiedPropertyName="k" PropertyValue="v"/>'
        '<properties FullyQualifiedPropertyName="l" PropertyValue="w" ConfigurationProfile="DOCKER"/></modules>'
        '</application_project><containers ContainerName="c" ImageField="i"><links LinksDependsOnField="d"/>'
        '<links LinksDependsOnField="e" DependencyOrder="2"/><ports ExposesPortsField="80"/></containers></application></r>'
    )
    facts = read_model_files(spark, str(tmp_path / "m.xmi"))
    assert rows(facts.property, "app_id", "seq", "name", "value", "profile") == {
        ("A", 0, "k", "v", "global"), ("A", 1, "l", "w", "DOCKER"),
    }
    assert rows(facts.container_link, "container", "dep_order", "target") == {("c", 1, "d"), ("c", 2, "e")}
    assert rows(facts.container, "name", "image", "generates_logs") == {("c", "i", False)}
    assert rows(facts.module, "artifact_id", "kind") == {("m", "Microservice")}


def test_java_part_of_a_model_file(spark, tmp_path):
    (tmp_path / "j.xmi").write_text(
        '<r><application ApplicationName="A"><application_project><modules ProjectArtifactId="m"><layers><elements '
        'xsi:type="PSM:JavaInterfaceType" xmlns:xsi="x" ElementIdentifier="I"/><elements ElementIdentifier="Api" PackageName="p" ElementProfile="TEST">'
        '<annotations AnnotationName="RequestMapping"><parameters ParameterValue="/v"/><parameters ParameterName="path" ParameterValue="/w"/></annotations>'
        '<extends ElementIdentifier="Base" PackageName="q"/><implements ElementIdentifier="I"/>'
        '<methods ElementIdentifier="add()"><annotations AnnotationName="PostMapping"/><parameters ElementIdentifier="user" ParameterOrder="2">'
        '<annotations AnnotationName="RequestBody"/><type ElementIdentifier="User" PackageName="p"/></parameters>'
        '<returns ElementIdentifier="User"/><invokes ElementIdentifier="exchange()" RootCallingMethod="add()">'
        '<parent ElementIdentifier="RestTemplate" PackageName="org"/><parameters FieldValue="u"/><parameters ElementIdentifier="x" ParameterOrder="2"/>'
        '</invokes></methods></elements></layers></modules></application_project></application></r>'
    )
    facts = read_model_files(spark, str(tmp_path / "j.xmi"))
    assert rows(facts.java_type, "type_id", "package", "kind", "profile") == {("I", "java.lang", "Interface", "COMPILE"), ("Api", "p", "Class", "TEST")}
    assert rows(facts.java_supertype, "relation", "target_id", "target_package") == {("extends", "Base", "q"), ("implements", "I", "java.lang")}
    assert rows(facts.java_annotation, "owner_kind", "annotation_name", "profile") == {
        ("type", "RequestMapping", "TEST"), ("method", "PostMapping", "TEST"), ("parameter", "RequestBody", "TEST"),
    }
    assert rows(facts.annotation_param, "param_name", "param_value") == {("value", "/v"), ("path", "/w")}
    assert rows(facts.java_method, "method_name", "return_type", "return_package") == {("add", "User", "java.lang")}
    assert rows(facts.method_param, "param_order", "param_name", "type_name", "type_package") == {(2, "user", "User", "p")}
    assert rows(facts.java_invocation, "root_method", "callee", "receiver_type", "receiver_package") == {("add()", "exchange", "RestTemplate", "org")}
    assert rows(facts.invocation_arg, "arg_order", "arg_name", "arg_value") == {(1, "NOT_AVAILABLE", "u"), (2, "x", "NOT_APPLICABLE")}
