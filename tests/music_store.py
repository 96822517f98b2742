"""Hand-typed facts of a small application and what must be derived from them."""

COMMON = [
    ("AppSettings.SiteTitle", "Music Store", "COMPILE"),
    ("AppSettings.CacheDbResults", "true", "COMPILE"),
    ("Logging.LogLevel.Default", "Information", "COMPILE"),
    ("Logging.LogLevel.System", "Warning", "COMPILE"),
    ("Logging.LogLevel.Microsoft", "Warning", "COMPILE"),
    ("Logging.LogLevel.Steeltoe", "Information", "COMPILE"),
    ("eureka.instance.StatusPageUrlPath", "/actuator/info", "COMPILE"),
    ("eureka.instance.HealthCheckUrlPath", "/actuator/health", "COMPILE"),
    ("mysql.client.username", "root", "COMPILE"),
    ("mysql.client.password", "steeltoe", "COMPILE"),
    ("management.endpoints.actuator.exposure.include", '[ "*" ]', "COMPILE"),
    ("management.tracing.alwaysSample", "true", "COMPILE"),
    ("management.tracing.useShortTraceIds", "true", "COMPILE"),
    ("management.tracing.exporterEndpoint", "http://zipkinserver:9411/api/v2/spans", "COMPILE"),
    ("spring.profiles", "Docker", "DOCKER"),
    ("eureka.client.serviceUrl", "http://eurekaserver:8761/eureka/", "DOCKER"),
    ("mysql.client.server", "mysql", "DOCKER"),
    ("management.tracing.exporter.zipkin.endpoint", "http://zipkinserver:9411/api/v2/spans", "DOCKER"),
    ("redis.client.host", "redis", "DOCKER"),
]
OWN = {
    "musicservice": [],
    "musicstore": [
        ("eureka.client.shouldFetchRegistry", "false"),
        ("mysql.client.database", "MusicService"),
        ("eureka.client.shouldRegisterWithEureka", "true"),
        ("mysql.client.database", "MusicStore"),
        ("DefaultAdminUsername", "Administrator@test.com"),
        ("DefaultAdminPassword", "YouShouldChangeThisPassword1!"),
        ("hystrix.command.default.circuitBreaker.requestVolumeThreshold", "3"),
    ],
    "orderservice": [
        ("eureka.client.shouldFetchRegistry", "false"),
        ("mysql.client.database", "OrderProcessing"),
    ],
    "shoppingcartservice": [
        ("eureka.client.shouldFetchRegistry", "false"),
        ("mysql.client.database", "ShoppingCart"),
        ("sqlserver.credentials.database", "ShoppingCart"),
    ],
}
BASE = "base AS final"
CONTAINERS = [
    ("configserver", "steeltoeoss/config-server", "", ["8888:8888"], []),
    ("eurekaserver", "steeltoeoss/eurekaserver", "", ["8761:8761"], []),
    ("spring-boot-admin", "hananiel/spring-boot-admin-eureka-sample", "", ["8889:8080"], ["eurekaserver"]),
    ("mysql", "mysql:5.7", "", [], ["configserver", "eurekaserver"]),
    ("zipkinserver", "steeltoeoss/zipkin", "", ["9411:9411"], []),
    ("musicservice", BASE, "./src/MusicStoreService", ["80"], ["configserver", "eurekaserver", "mysql"]),
    ("shoppingcartservice", BASE, "./src/ShoppingCartService", ["80"], ["configserver", "eurekaserver", "mysql"]),
    ("orderservice", BASE, "./src/OrderService", ["80"], ["configserver", "eurekaserver", "mysql"]),
    (
        "musicstore",
        BASE,
        "./src/MusicStoreUI",
        ["80"],
        ["configserver", "eurekaserver", "musicservice", "shoppingcartservice", "orderservice", "mysql"],
    ),
]


def rows(app="Music Store"):
    """Fact rows by table, in the column order of the schemas."""
    compose = "docker-compose.yml"
    tables = {
        "application": [(app, 0, app, "src")],
        "app_project": [(app, 0, app, "", app)],
        "module": [(app, at, app, "", name, "Microservice") for at, name in enumerate(OWN)],
        "property": [
            (app, at, module, "application.yml", name, value, profile)
            for module, own in OWN.items()
            for at, (name, value, profile) in enumerate(COMMON + [(*pair, "COMPILE") for pair in own])
        ],
        "container": [
            (app, at, app, compose, name, image, build, False)
            for at, (name, image, build, _, _) in enumerate(CONTAINERS)
        ],
        "container_port": [
            (app, at, app, compose, name, port)
            for name, _, _, ports, _ in CONTAINERS
            for at, port in enumerate(ports)
        ],
        "container_link": [
            (app, at, app, compose, name, at + 1, target)
            for name, _, _, _, links in CONTAINERS
            for at, target in enumerate(links)
        ],
    }
    return tables
