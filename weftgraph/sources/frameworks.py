"""Framework evidence from source text: routes, handlers, schedules, messages, GraphQL, injection, and message producers.

Each adapter reads declarations by pattern and says what is declared, never what a runtime does with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "path string, framework string, kind string, logical_key string, relation_kind string, handler string, line int"
PRODUCERS = "path string, framework string, protocol_kind string, producer_kind string, destination_kind string, destination string, line int"

# Verbs of route decorators and annotations.
_NEST_ROUTE = re.compile(r"@(Get|Post|Put|Delete|Patch|Options|Head|All)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)")
_NEST_HANDLER = re.compile(r"@(Query|Mutation|Subscription|ResolveField|Cron|Interval|Timeout|MessagePattern|EventPattern)\(\s*(?:\(\)\s*=>\s*\w+\s*,?)?\s*(?:['\"]([^'\"]*)['\"]|(\d+))?")
_NEST_CLASS = re.compile(r"@(Controller|Resolver|Injectable|Module)\(\s*(?:['\"]([^'\"]*)['\"])?")
_SPRING_ROUTE = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:\{\s*)?\"([^\"]*)\"|\(\s*\)|(?!\())")
_SPRING_HANDLER = re.compile(r"@(Scheduled|KafkaListener|RabbitListener|JmsListener|QueryMapping|MutationMapping|SubscriptionMapping|SchemaMapping|Bean)(?:\(([^)]*)\))?")
_METHOD = re.compile(r"(?:(?:public|private|protected|async|static|final|readonly|override|suspend|fun)\s+)*(?:[\w<>\[\],.? ]+\s+)?(\w+)\s*\(")
_CLASS = re.compile(r"\bclass\s+(\w+)")
_FLUTTER_ROUTE = re.compile(r"(?:GoRoute\(\s*path:\s*|['\"](?=/))['\"]?(/[^'\"]*)['\"]\s*(?:,|:\s*\()")
_STRING = re.compile(r"[\"']([^\"']+)[\"']")
_NEST_SEND = re.compile(r"\b(?:this\.)?(\w*(?:[cC]lient|[pP]roxy|[bB]us|[eE]mitter)\w*)\.(emit|send)\(\s*(?:['\"`]([^'\"`$]+)['\"`]|(\w+))")
_SPRING_SEND = re.compile(r"\b(\w*(?:[kK]afka|[rR]abbit|[jJ]ms)Template)\.(send|convertAndSend)\(\s*(?:\"([^\"]+)\"|(\w+))")


def route_path(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def _name_after(text: str, at: int) -> str:
    """The method or class that a decorator at this place stands before; further decorators are passed."""
    rest = text[at : at + 2000]
    rest = re.sub(r"^[^\n]*\n", "", rest, count=1) if "\n" in rest else rest
    while m := re.match(r"\s*@\w+(?:\((?:[^()]|\([^()]*\))*\))?\s*", rest):
        rest = rest[m.end() :]
    m = _CLASS.search(rest.split("{")[0]) or _METHOD.search(rest)
    return m[1] if m else ""


def key(**parts: str) -> str:
    return json.dumps(parts, sort_keys=True, separators=(",", ":"))


def nest(path: str, text: str) -> Iterator[tuple]:
    line = lambda m: text.count("\n", 0, m.start()) + 1
    bases = [(m.start(), m[2] or "") for m in _NEST_CLASS.finditer(text) if m[1] == "Controller"]
    for m in _NEST_ROUTE.finditer(text):
        base = next((b for at, b in reversed(bases) if at < m.start()), None)
        if base is not None:
            yield path, "nestjs", "route", key(method=m[1].upper(), path=route_path(base, m[2] or "")), "controller_route", _name_after(text, m.end()), line(m)
    for m in _NEST_HANDLER.finditer(text):
        name, handler = m[2] or m[3] or "", _name_after(text, m.end())
        if m[1] in ("Query", "Mutation", "Subscription", "ResolveField"):
            kind = "graphql_field" if m[1] == "ResolveField" else "graphql_operation"
            yield path, "nestjs", kind, key(operation=m[1].lower(), name=name or handler), "graphql_resolver", handler, line(m)
        elif m[1] in ("Cron", "Interval", "Timeout"):
            yield path, "nestjs", "scheduled_job", key(schedule=m[1].lower(), value=name, handler=handler), "scheduled_handler", handler, line(m)
        else:
            yield path, "nestjs", "message_consumer", key(consumer="request" if m[1] == "MessagePattern" else "event", destination=name), "message_handler", handler, line(m)
    for m in _NEST_CLASS.finditer(text):
        if m[1] in ("Injectable", "Module"):
            yield path, "nestjs", "component", key(kind=m[1].lower(), name=_name_after(text, m.end())), "module_provider" if m[1] == "Module" else "dependency_injection", _name_after(text, m.end()), line(m)


def spring(path: str, text: str) -> Iterator[tuple]:
    line = lambda m: text.count("\n", 0, m.start()) + 1
    classes = [m.start() for m in _CLASS.finditer(text)]
    base = ""
    for m in _SPRING_ROUTE.finditer(text):
        before_class = any(at > m.start() for at in classes) and m[1] == "Request" and not any(at < m.start() for at in classes)
        if before_class:
            base = m[2] or ""
            continue
        yield path, "spring", "route", key(method="ANY" if m[1] == "Request" else m[1].upper(), path=route_path(base, m[2] or "")), "controller_route", _name_after(text, m.end()), line(m)
    for m in _SPRING_HANDLER.finditer(text):
        handler, value = _name_after(text, m.end()), (_STRING.search(m[2] or "") or [None, ""])[1]
        if m[1] == "Scheduled":
            yield path, "spring", "scheduled_job", key(schedule=(m[2] or "").strip(), handler=handler), "scheduled_handler", handler, line(m)
        elif m[1].endswith("Listener"):
            yield path, "spring", "message_consumer", key(consumer=m[1].removesuffix("Listener").lower(), destination=value), "message_handler", handler, line(m)
        elif m[1] == "Bean":
            yield path, "spring", "component", key(kind="bean", name=value or handler), "bean_relationship", handler, line(m)
        else:
            yield path, "spring", "graphql_field" if m[1] == "SchemaMapping" else "graphql_operation", key(operation=m[1].removesuffix("Mapping").lower(), name=value or handler), "graphql_resolver", handler, line(m)


def next_pages(path: str, text: str) -> Iterator[tuple]:
    """File routes of the pages and app folders, and client or server boundaries."""
    m = re.search(r"(?:^|/)(?:src/)?(app|pages)/(.*?)([^/]+)\.(?:tsx|ts|jsx|js)$", path)
    if m:
        folder, name = m[2].strip("/"), m[3]
        parts = [p for p in folder.split("/") if p and not re.fullmatch(r"\(.*\)", p)]
        if m[1] == "app" and name in ("page", "route", "layout"):
            kind, relation = ("layout", "layout_binding") if name == "layout" else ("route", "route_binding")
            yield path, "next", kind, key(method="PAGE" if name != "route" else "ANY", path=route_path(*parts)), relation, name, 1
        elif m[1] == "pages" and not name.startswith("_"):
            yield path, "next", "route", key(method="ANY" if parts[:1] == ["api"] else "PAGE", path=route_path(*parts, "" if name == "index" else name)), "route_binding", name, 1
    if d := re.match(r"\s*(?://[^\n]*\n|/\*.*?\*/|\s)*['\"]use (client|server)['\"]", text, re.S):
        yield path, "react", "boundary", key(value=d[1]), "execution_boundary", d[1], 1
    for c in re.finditer(r"<([A-Z]\w*)[\s/>]", text):
        yield path, "react", "component", key(name=c[1]), "component_usage", c[1], text.count("\n", 0, c.start()) + 1


def flutter(path: str, text: str) -> Iterator[tuple]:
    for m in _FLUTTER_ROUTE.finditer(text):
        yield path, "flutter", "route", key(method="PAGE", path=m[1]), "navigation_binding", "", text.count("\n", 0, m.start()) + 1
    for m in re.finditer(r"class\s+(\w+)\s+extends\s+(StatelessWidget|StatefulWidget)", text):
        yield path, "flutter", "component", key(name=m[1]), "widget_composition", m[1], text.count("\n", 0, m.start()) + 1


ADAPTERS = {"typescript": (nest, next_pages), "tsx": (next_pages, nest), "javascript": (next_pages,), "java": (spring,), "kotlin": (spring,), "dart": (flutter,)}


def producers_of(path: str, text: str) -> Iterator[tuple]:
    """Calls that send messages; a destination that isn't a literal is unknown."""
    for pattern, framework in ((_NEST_SEND, "nestjs"), (_SPRING_SEND, "spring")):
        for m in pattern.finditer(text):
            protocol = "nest" if framework == "nestjs" else re.search("kafka|rabbit|jms", m[1].lower())[0]
            kind = {"emit": "event", "send": "request" if framework == "nestjs" else protocol}.get(m[2], protocol)
            yield path, framework, protocol, kind, "literal" if m[3] else "unknown", m[3] or m[4], text.count("\n", 0, m.start()) + 1


def _mapped(read, columns: str):
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([row for p, lang, t in zip(b.path, b.language, b.content, strict=True) for row in read(p, lang, t or "")], columns=names)

    return run


def framework_evidence(files: DataFrame) -> DataFrame:
    """EVIDENCE rows of files (path, language, content)."""
    read = lambda p, lang, t: (row for adapter in ADAPTERS.get(lang, ()) for row in adapter(p, t))
    return files.select("path", "language", "content").mapInPandas(_mapped(read, EVIDENCE), EVIDENCE)


def message_producers(files: DataFrame) -> DataFrame:
    """PRODUCERS rows of files (path, language, content)."""
    return files.select("path", "language", "content").mapInPandas(_mapped(lambda p, lang, t: producers_of(p, t), PRODUCERS), PRODUCERS)


def detected(evidence: DataFrame) -> DataFrame:
    """framework, files, outputs."""
    return evidence.groupBy("framework").agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("outputs"))


def framework_edges(evidence: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (framework, kind, logical_key) and their relations to symbols: a handler binds where its file has exactly one symbol of its name."""
    entities = evidence.select("framework", "kind", "logical_key").distinct()
    named = symbols.select(F.col("file").alias("path"), F.col("name").alias("handler"), "id")
    bound = evidence.join(named, ["path", "handler"]).groupBy("framework", "kind", "logical_key", "relation_kind", "path", "handler").agg(F.count_distinct("id").alias("n"), F.min("id").alias("node_id")).filter("n = 1")
    return entities, bound.select("framework", "kind", "logical_key", "relation_kind", "node_id")


def invalid_owners(inputs: DataFrame, changed: DataFrame) -> DataFrame:
    """owner_key of the owners whose input or lookup keys (array keys) meet the changed keys (column key)."""
    return inputs.select("owner_key", F.explode("keys").alias("key")).join(changed.select("key"), "key", "left_semi").select("owner_key").distinct()
