"""Bench inputs as DataFrame expressions: any size without driver memory.

Shapes: a realistic mix, lines with unique ids, few repeated messages, and lines
of chosen length. A fixed base time makes them repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "2024-01-01 00:00:00"

# Fixed values of the bench input, as published: sources, messages and what fills them.
# {n:lo-hi} is a number, {a|b|c} one of the words.
NAMESPACES = ["default", "kube-system", "monitoring", "app-prod", "app-staging"]
SERVICES = ["web-server", "api-gateway", "database", "cache", "worker", "scheduler"]
PATTERNS = [
    "ERROR: Connection timeout to database server db-{n:1-5}:{n:3000-9000} after {n:100-5000}ms",
    "INFO: User user_{n:1000-9999} successfully authenticated from IP {n:1-255}.{n:1-255}.{n:1-255}.{n:1-255}",
    "WARN: High memory usage detected: {n:60-95}% of {n:1024-16384}MB used",
    "ERROR: Failed to process payment for order ORD{n:100000-999999}: {Insufficient funds|Card declined|Network error|Timeout}",
    "INFO: Starting HTTP server on port {n:3000-9000} with {n:1-8} workers",
    "DEBUG: Cache hit for key 'cache_{n:1-1000}' in {n:1-50}ms",
    "ERROR: Invalid JSON payload received: {Unexpected token|Missing field|Invalid format}",
    "INFO: Scheduled job '{cleanup|backup|report|sync}' completed successfully in {n:100-5000}s",
    "WARN: Rate limit exceeded for API key api_{n:1000-9999}: {n:100-1000} requests",
    "ERROR: Database query failed: {Connection lost|Syntax error|Table not found} (query: SELECT * FROM table_{n:1-10})",
    "INFO: File 'file_{n:1-1000}.{jpg|pdf|txt|csv}' uploaded successfully ({n:1024-1048576} bytes)",
    "WARN: SSL certificate expires in {n:1-30} days for domain {example|test|demo|app}.com",
    "ERROR: Service '{web-server|api-gateway|database|cache|worker|scheduler}' health check failed: {200|404|500|503}",
    "INFO: New user registration: user{n:1-1000}@example.com from {US|UK|CA|DE|FR}",
    "DEBUG: Processing webhook payload from {github|stripe|slack} (size: {n:100-10000} bytes)",
    "ERROR: Failed to send email to user{n:1-100}@domain.com: {Connection refused|Authentication failed|Rate limited}",
    "INFO: Background task '{email|report|cleanup|backup}' queued with priority {n:1-5}",
    "WARN: Slow query detected: {n:1000-10000}ms for table 'table_{n:1-20}'",
    "ERROR: Authorization failed for user user_{n:1-100} accessing resource /api/v1/{users|orders|products|reports}",
    "INFO: Cache entry 'session_{n:1-1000}' expired after {n:300-3600} seconds",
]
LOW_DIVERSITY = [
    "ERROR: Database connection failed", "INFO: Request processed successfully", "WARN: High memory usage detected",
    "ERROR: Authentication failed", "INFO: Service started successfully",
]
LOW_NAMESPACES, LOW_SERVICES = ["default", "app-prod"], ["web-server", "database"]
LENGTH_NAMESPACES, LENGTH_SERVICES = ["default", "kube-system", "monitoring"], ["web-server", "api-gateway", "database"]


def _draw(salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 31))


def _number(lo: int, hi: int, salt: int) -> Column:
    return (_draw(salt) % (hi - lo + 1) + lo).cast("string")


def _one_of(values: list[str], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(salt) % len(values) + 1).cast("int"))


def _filled(pattern: str, salt: int) -> Column:
    parts, rest = [], pattern
    while "{" in rest:
        head, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        salt += 1
        parts.append(F.lit(head))
        if slot.startswith("n:"):
            parts.append(_number(*map(int, slot[2:].split("-")), salt))
        else:
            parts.append(_one_of(slot.split("|"), salt))
    return F.concat(*parts, F.lit(rest))


def _clock(form: str) -> Column:
    return F.date_format(F.lit(BASE).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 86400), form)


def _with_sources(df: DataFrame, line: Column, namespaces=NAMESPACES, services=SERVICES) -> DataFrame:
    return df.select(
        line.alias("line"),
        _one_of(namespaces, 901).alias("namespace"),
        F.concat(_one_of(services, 902), F.lit("-"), _number(1, 10, 903)).alias("pod"),
        _one_of(services, 904).alias("container"),
    )


def realistic(spark: SparkSession, n: int) -> DataFrame:
    size = F.element_at(
        F.array(*[F.lit(s) for s, w in ((1000, 6), (500, 4), (100, 5), (50, 3), (1, 2)) for _ in range(w)]),
        (_draw(900) % 20 + 1).cast("int"),
    )
    which = F.floor(F.col("id") / size) % len(PATTERNS)
    line = F.lit(None).cast("string")
    for i, pattern in enumerate(PATTERNS):
        line = F.when(which == i, _filled(pattern, 20 * i)).otherwise(line)
    return _with_sources(spark.range(n), line)


def high_diversity(spark: SparkSession, n: int) -> DataFrame:
    line = F.concat(
        _one_of(["ERROR", "WARN", "INFO", "DEBUG"], 1), F.lit(" ["), _clock("yyyy-MM-dd HH:mm:ss"), F.lit("] "),
        _one_of(SERVICES, 2), F.lit(": Operation op_"), "id", F.lit(" completed with status "), _number(200, 599, 3),
        F.lit(" in "), _number(1, 4999, 4), F.lit("ms for resource resource_"), _number(1, 999, 5),
        F.lit(" (correlation_id: corr_"), "id", F.lit(")"),
    )
    return _with_sources(spark.range(n), line)


def low_diversity(spark: SparkSession, n: int) -> DataFrame:
    line = F.concat(_one_of(LOW_DIVERSITY, 1), F.lit(" at "), _clock("HH:mm:ss"))
    return _with_sources(spark.range(n), line, LOW_NAMESPACES, LOW_SERVICES)


def of_length(spark: SparkSession, n: int, lo: int, hi: int) -> DataFrame:
    """Lines of four kinds, filled up and cut to a length between ``lo`` and ``hi``."""
    wanted = (_draw(2) % (hi - lo + 1) + lo).cast("int")
    head = F.concat(_one_of(["ERROR", "WARN", "INFO", "DEBUG"], 3), F.lit(" ["), _one_of(LENGTH_SERVICES, 4), F.lit("] "))
    left = wanted - F.length(head)
    times = lambda text, k: F.repeat(F.lit(text), k.cast("int"))
    fillers = [
        F.concat(F.lit("Processing request "), _number(1000, 9998, 5), F.lit(" with parameters: "), times("x", F.greatest(left - 50, F.lit(0)))),
        F.concat(F.lit("Database query executed in "), _number(1, 999, 6), F.lit("ms: SELECT * FROM table WHERE "),
                 times("field = value AND ", F.floor(left / 20))),
        F.concat(F.lit("Network request to api.example.com:"), _number(80, 8999, 7), F.lit(" completed with response: "),
                 times("data", F.floor(left / 4))),
        F.concat(F.lit("Operation completed successfully with details: "), times("detail ", F.floor(left / 7))),
    ]
    filler = F.lit("")
    for k, f in enumerate(fillers):
        filler = F.when((F.col("id") % 4 == k) & (left > 20), f).otherwise(filler)
    line = F.left(F.concat(head, filler), wanted)
    return _with_sources(spark.range(n), line, LENGTH_NAMESPACES, LENGTH_SERVICES)
