"""Query trees: parsing, parameters, and compilation to column expressions.

A file holds a list of ``{name, child}``; a parameter file a list of
``{name, params: [{name, value}]}``. Every (query, parameter set) pair becomes a
few columns over one scan of the documents: a document's row holds all its
terms, so no query needs a shuffle before the cut to the best n.

A node's value is a sign and the logarithm of its size, so that sums of very
small probabilities keep their order. A missing value (``drop``) makes what
stands above it missing, and the document leaves that query's ranking.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.operators.phrases import shifted
from thicket.operators.ranking import rank

try:
    import yaml
except ImportError:  # JSON files, which are YAML too, need no parser of their own
    yaml = None

WINNERS = 100_000  # document ids (8 bytes each, or a short name) that may travel to every worker
KEY = " "  # joins a phrase's tokens


@dataclass(frozen=True)
class Parameter:
    name: str


Number = float | Parameter


@dataclass(frozen=True)
class Constant:
    value: Number


@dataclass(frozen=True)
class Drop:
    pass


@dataclass(frozen=True)
class Sum:
    children: tuple
    name: str | None = None
    record: str | None = None


@dataclass(frozen=True)
class Product:
    children: tuple
    name: str | None = None
    record: str | None = None


@dataclass(frozen=True)
class Scale:
    scalar: Number
    child: object
    name: str | None = None
    record: str | None = None


@dataclass(frozen=True)
class Feature:
    name: str
    is_log: bool
    child: object


@dataclass(frozen=True)
class If:
    terms: tuple[tuple[str, ...], ...]
    negated: bool
    true_child: object
    false_child: object


@dataclass(frozen=True)
class Smoothing:
    kind: str
    mu: Number | None = None
    foreground: Number | None = None
    background: Number | None = None


@dataclass(frozen=True)
class Likelihood:
    field: str
    terms: tuple[tuple[tuple[str, ...], float], ...]
    smoothing: Smoothing
    name: str | None = None
    record: str | None = None


Node = Constant | Drop | Sum | Product | Scale | Feature | If | Likelihood


# --- parsing -----------------------------------------------------------------


def load(text: str) -> object:
    """JSON, or YAML where a parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        if yaml is None:
            raise ValueError("this file is no JSON and no YAML parser is installed") from None
        return yaml.safe_load(text)


def number(x: object) -> Number:
    if isinstance(x, str):
        m = re.fullmatch(r"\{\{([^\W\d_]\w*)\}\}", x)
        if not m:
            raise ValueError(f"no parameter: {x!r}")
        return Parameter(m[1])
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise ValueError(f"no number: {x!r}")
    return float(x)


def split_tokens(term: str, raw: bool = False) -> tuple[str, ...]:
    """A query term's tokens by the rules for documents; ``raw`` leaves them as they stand between punctuation."""
    tokens = term.translate({ord(c): " " for c in X.PUNCTUATION}).split()
    if raw:
        return tuple(tokens)
    folded = ("".join(c for c in t.replace("ß", "ss").lower() if c.isalpha()) for t in tokens)
    return tuple(t for t in folded if len(t) > 2)


def weighted(x: object) -> tuple[str, float]:
    return (x["term"], float(x["weight"])) if isinstance(x, dict) else (x, 1.0)


def parse_smoothing(o: dict) -> Smoothing:
    kind = o["type"]
    if kind == "none":
        return Smoothing("none")
    if kind == "dirichlet":
        return Smoothing("dirichlet", mu=number(o["mu"]))
    if kind == "jm":
        return Smoothing("jm", foreground=number(o["alpha_foreground"]), background=number(o["alpha_background"]))
    raise ValueError(f"unknown smoothing {kind!r}")


def parse_node(o: dict, raw: bool = False) -> Node:
    kind, name = o.get("type"), o.get("name")
    record = o.get("record", False)
    record = name if record is True else None if record is False else record
    sub = lambda k: parse_node(o[k], raw)
    if kind == "constant":
        return Constant(number(o["value"]))
    if kind == "drop":
        return Drop()
    if kind == "aggregator":
        if o["op"] not in ("sum", "product"):
            raise ValueError(f"unknown aggregator {o['op']!r}")
        return (Sum if o["op"] == "sum" else Product)(tuple(parse_node(c, raw) for c in o["children"]), name, record)
    if kind == "scale":
        return Scale(number(o["scalar"]), sub("child"), name, record)
    if kind == "feature":
        return Feature(o["name"], bool(o["isLog"]), sub("child"))
    if kind == "if":
        terms = tuple(tuple(t) if isinstance(t, list) else split_tokens(t, raw) for t in o["terms"])
        return If(tuple(t for t in terms if t), bool(o.get("negated", False)), sub("true_child"), sub("false_child"))
    if kind == "scoring_model":
        model = o["retrieval_model"]
        if model["type"] != "ql":
            raise ValueError(f"unknown retrieval model {model['type']!r}")
        pairs = [weighted(t) for t in o["terms"]]
        if o["field"] == "freebase_id":
            terms = [((t,), w) for t, w in pairs]
        elif o["field"] == "text":
            terms = [(s, w) for t, w in pairs if (s := tuple(t) if isinstance(t, list) else split_tokens(t, raw))]
        else:
            raise ValueError(f"unknown field {o['field']!r}")
        return Likelihood(o["field"], tuple(terms), parse_smoothing(model["smoothing"]), name, record)
    raise ValueError(f"unknown node type {kind!r}")


def parse_queries(text: str, raw_query_terms: bool = False) -> dict[str, Node]:
    return {o["name"]: parse_node(o["child"], raw_query_terms) for o in load(text)}


def parse_parameters(text: str) -> dict[str, dict[str, float]]:
    return {o["name"]: {p["name"]: float(p["value"]) for p in o["params"]} for o in load(text)}


def to_json(node: Node) -> dict:
    """What ``parse_node`` reads as the same node."""
    n = lambda x: f"{{{{{x.name}}}}}" if isinstance(x, Parameter) else x
    t = lambda tokens: tokens[0] if len(tokens) == 1 else list(tokens)
    extra = {k: v for k, v in (("name", getattr(node, "name", None)), ("record", getattr(node, "record", None))) if v is not None}
    match node:
        case Constant():
            return {"type": "constant", "value": n(node.value)}
        case Drop():
            return {"type": "drop"}
        case Sum() | Product():
            return {"type": "aggregator", "op": type(node).__name__.lower(), "children": [to_json(c) for c in node.children]} | extra
        case Scale():
            return {"type": "scale", "scalar": n(node.scalar), "child": to_json(node.child)} | extra
        case Feature():
            return {"type": "feature", "name": node.name, "isLog": node.is_log, "child": to_json(node.child)}
        case If():
            return {"type": "if", "terms": [list(x) for x in node.terms], "negated": node.negated, "true_child": to_json(node.true_child), "false_child": to_json(node.false_child)}
        case Likelihood():
            s = node.smoothing
            smoothing = {"none": {}, "dirichlet": {"mu": n(s.mu)}, "jm": {"alpha_foreground": n(s.foreground), "alpha_background": n(s.background)}}[s.kind]
            terms = [{"term": t(tokens), "weight": w} for tokens, w in node.terms]
            return {"type": "scoring_model", "field": node.field, "terms": terms, "retrieval_model": {"type": "ql", "smoothing": {"type": s.kind} | smoothing}} | extra
    raise TypeError(node)


# --- what a tree asks for --------------------------------------------------------


def walk(node: Node) -> list[Node]:
    children = {Sum: ("children",), Product: ("children",), Scale: ("child",), Feature: ("child",), If: ("true_child", "false_child")}.get(type(node), ())
    below = [c for k in children for c in (getattr(node, k) if k == "children" else (getattr(node, k),))]
    return [node, *(x for c in below for x in walk(c))]


def field_terms(node: Node, field_: str) -> set[tuple[str, ...]]:
    return {tokens for x in walk(node) if isinstance(x, Likelihood) and x.field == field_ for tokens, _ in x.terms}


def predicate_terms(node: Node) -> set[tuple[str, ...]]:
    return {t for x in walk(node) if isinstance(x, If) for t in x.terms}


def feature_names(node: Node) -> list[str]:
    return sorted({x.name for x in walk(node) if isinstance(x, Feature)})


def parameter_names(node: Node) -> set[str]:
    found = {x.name for x in walk(node) if isinstance(x, Feature)}
    for x in walk(node):
        parts = [x.smoothing] if isinstance(x, Likelihood) else [x]
        found |= {v.name for p in parts for v in vars(p).values() if isinstance(v, Parameter)}
    return found


# --- matching ----------------------------------------------------------------------


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with doc_len (tokens with a letter or digit) and terms (folded, longer than two letters); the text stays."""
    words = X.split_words(X.strip_punctuation(F.coalesce(text, F.lit(""))))
    docs = docs.withColumn("_words", words).withColumn("doc_len", F.size(F.filter("_words", X.has_alphanumeric)))
    return docs.withColumn("terms", F.filter(F.transform("_words", X.letters_only), lambda t: F.length(t) > 2)).drop("_words")


def hits(terms: Column, vocabulary: set[tuple[str, ...]]) -> Column:
    """Array of keys: the vocabulary's tokens and phrases in an array of terms, one for each place.

    A phrase is matched among the given terms, so words that were dropped
    before don't part it.
    """
    tokens = sorted({t[0] for t in vocabulary if len(t) == 1})
    parts = [F.filter(terms, lambda t: t.isin(tokens)) if tokens else F.array().cast("array<string>")]
    parts += [_phrase_hits(terms, phrase) for phrase in sorted(t for t in vocabulary if len(t) > 1)]
    return F.concat(*parts)


def tree_vocabulary(queries: dict[str, Node]) -> set[tuple[str, ...]]:
    return set().union(*(field_terms(q, "text") | predicate_terms(q) for q in queries.values()))


def matched(documents: DataFrame, queries: dict[str, Node]) -> DataFrame:
    """``prepared`` documents with _hits, what the queries ask for, in place of text and terms; small enough to be stored."""
    return documents.withColumn("_hits", hits(F.col("terms"), tree_vocabulary(queries))).drop("text", "terms")


def _phrase_hits(terms: Column, phrase: tuple[str, ...]) -> Column:
    same = F.filter(shifted(terms, len(phrase)), lambda z: reduce(lambda a, b: a & b, (z.getField(str(i)) == word for i, word in enumerate(phrase))))
    return F.transform(same, lambda z: F.lit(KEY.join(phrase)))


def positions(terms: Column, vocabulary: set[tuple[str, ...]]) -> Column:
    """Array of (key, position), for an array of (term, token_pos, char_pos)."""
    at = lambda x: F.struct(x["token_pos"].alias("token_pos"), x["char_pos"].alias("char_pos"))
    tokens = sorted({t[0] for t in vocabulary if len(t) == 1})
    parts = [F.transform(F.filter(terms, lambda x: x["term"].isin(tokens)), lambda x: F.struct(x["term"].alias("key"), at(x).alias("position")))]
    parts += [_phrase_positions(terms, phrase) for phrase in sorted(t for t in vocabulary if len(t) > 1)]
    return F.concat(*parts)


def _phrase_positions(terms: Column, phrase: tuple[str, ...]) -> Column:
    last = str(len(phrase) - 1)
    same = F.filter(shifted(terms, len(phrase)), lambda z: reduce(lambda a, b: a & b, (z.getField(str(i))["term"] == word for i, word in enumerate(phrase))))
    # terms stand in order: a phrase runs from its first term's begin to its last one's end
    span = lambda z: F.struct(z.getField("0")["char_pos"]["begin"].alias("begin"), z.getField(last)["char_pos"]["end"].alias("end"))
    return F.transform(same, lambda z: F.struct(F.lit(KEY.join(phrase)).alias("key"), F.struct(z.getField("0")["token_pos"].alias("token_pos"), span(z).alias("char_pos")).alias("position")))


@dataclass
class Background:
    """Collection frequencies of a query vocabulary and the collection's length."""

    length: float
    counts: dict[str, float] = field(default_factory=dict)
    unseen: float = 0.5

    def probability(self, key: str) -> float:
        return self.counts.get(key, self.unseen) / self.length if self.length else 0.0


def corpus_statistics(documents: DataFrame, vocabulary: set[tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """(term, df, cf) of the vocabulary's tokens and phrases; (n_docs, n_tokens) of all ``prepared`` (or ``matched``) documents."""
    if "_hits" in documents.columns:
        found = F.filter("_hits", lambda x: x.isin(sorted(KEY.join(t) for t in vocabulary)))
    else:
        found = hits(F.col("terms"), vocabulary)
    found = documents.select("doc_id", F.explode(found).alias("term"))
    per = found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return stats, documents.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_tokens"))


def background(stats: DataFrame, corpus: DataFrame, vocabulary: set[tuple[str, ...]], unseen: float = 0.5) -> Background:
    """The few rows that the queries need, in the driver."""
    keys = sorted(KEY.join(t) for t in vocabulary)
    counts = {r.term: float(r.cf) for r in stats.where(F.col("term").isin(keys)).collect()} if keys else {}
    return Background(float(corpus.first()["n_tokens"] or 0), counts, unseen)


# --- compilation ---------------------------------------------------------------------


@dataclass
class Value:
    sign: Column  # null: missing
    ln: Column


NEG_INF = float("-inf")


def _literal(x: float) -> Value:
    sign = (x > 0) - (x < 0)
    return Value(F.lit(float(sign)), F.log(F.lit(abs(x))) if x else F.lit(NEG_INF))


class Compiler:
    """Columns of one query with one parameter set; ``frame`` gains a pair of columns a node."""

    def __init__(self, frame: DataFrame, prefix: str, parameters: dict[str, float], text_bg: Background, entity_bg: Background, entity_length: bool = False):
        self.frame, self.prefix, self.parameters, self.n = frame, prefix, parameters, 0
        self.backgrounds = {"text": text_bg, "freebase_id": entity_bg}
        self.entity_length = entity_length

    def number(self, x: Number) -> float:
        if isinstance(x, Parameter):
            if x.name not in self.parameters:
                raise KeyError(f"missing parameter value: {x.name}")
            return self.parameters[x.name]
        return x

    def kept(self, v: Value) -> Value:
        """As columns of the frame, so that what stands above doesn't repeat the expression."""
        name = f"{self.prefix}_{self.n}"
        self.n += 1
        self.frame = self.frame.withColumns({f"{name}_s": v.sign, f"{name}_l": v.ln})
        return Value(F.col(f"{name}_s"), F.col(f"{name}_l"))

    def compile(self, node: Node) -> tuple[Value, list[tuple[str, Value]]]:
        """The node's value and what it records; of one name the outer, and of siblings the earlier-listed, is last."""
        record = getattr(node, "record", None)
        match node:
            case Constant():
                return _literal(self.number(node.value)), []
            case Drop():
                return Value(F.lit(None).cast("double"), F.lit(None).cast("double")), []
            case Sum() | Product():
                made = [self.compile(c) for c in node.children]
                values = [v for v, _ in made]
                v = self.kept((_sum if isinstance(node, Sum) else _product)(values))
                recorded = [r for _, rs in made for r in rs]
            case Scale():
                child, recorded = self.compile(node.child)
                v = self.kept(_product([_literal(self.number(node.scalar)), child]))
            case Feature():
                child, recorded = self.compile(node.child)
                v = self.kept(_log(child) if node.is_log else child)
                weight = self.number(Parameter(node.name))
                return self.kept(_product([_literal(weight), v])), [*recorded, (node.name, v)]
            case If():
                yes, a = self.compile(node.true_child)
                no, b = self.compile(node.false_child)
                found = F.lit(True)
                for t in node.terms:
                    found = found & F.array_contains("_hits", KEY.join(t))
                test = ~found if node.negated else found
                # what the branch not taken records is missing
                chosen = [(n, Value(F.when(test, x.sign), x.ln)) for n, x in a] + [(n, Value(F.when(~test, x.sign), x.ln)) for n, x in b]
                return self.kept(Value(F.when(test, yes.sign).otherwise(no.sign), F.when(test, yes.ln).otherwise(no.ln))), chosen
            case Likelihood():
                v, recorded = self.kept(Value(F.lit(1.0), self.likelihood(node))), []
        return v, [*recorded, *([(record, v)] if record else [])]

    def likelihood(self, node: Likelihood) -> Column:
        weights: dict[str, float] = {}
        for tokens, w in node.terms:
            weights[KEY.join(tokens)] = weights.get(KEY.join(tokens), 0.0) + w
        bg, s = self.backgrounds[node.field], node.smoothing
        length = F.col("entity_len" if node.field == "freebase_id" and self.entity_length else "doc_len").cast("double")
        total = F.lit(0.0)
        for key, w in sorted(weights.items()):
            if node.field == "text":
                tf = _count(key)
            else:
                tf = F.coalesce(F.element_at("entities", F.lit(key)), F.lit(0)).cast("double")
            p, share = bg.probability(key), F.when(length > 0, tf / length).otherwise(F.lit(0.0))
            if s.kind == "none":
                prob = share
            elif s.kind == "dirichlet":
                mu = self.number(s.mu)
                prob = (tf + mu * p) / (length + mu)
            else:
                fg, back = self.number(s.foreground), self.number(s.background)
                prob = fg / (fg + back) * share + (1 - fg / (fg + back)) * p
            total = total + w * X.ln(prob)
        return total


def _count(key: str) -> Column:
    return F.size(F.filter("_hits", lambda x: x == key)).cast("double")


def _any_in(array: str | Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(array, F.array(*map(F.lit, wanted)))


def _product(values: Sequence[Value]) -> Value:
    if not values:
        return _literal(1.0)
    sign = reduce(lambda a, b: a * b, (v.sign for v in values))
    return Value(sign, F.when(sign == 0, F.lit(NEG_INF)).otherwise(reduce(lambda a, b: a + b, (v.ln for v in values))))


def _sum(values: Sequence[Value]) -> Value:
    if not values:
        return _literal(0.0)
    if len(values) == 1:
        return values[0]
    top = F.greatest(*(v.ln for v in values))
    total = reduce(lambda a, b: a + b, (v.sign * F.when(top == NEG_INF, F.lit(0.0)).otherwise(F.exp(v.ln - top)) for v in values))
    missing = reduce(lambda a, b: a | b, (v.sign.isNull() for v in values))
    return Value(F.when(~missing, F.signum(total)), F.when(total == 0, F.lit(NEG_INF)).otherwise(top + F.log(F.abs(total))))


def _log(v: Value) -> Value:
    """The logarithm of a positive value is its ``ln``; there is none of a negative one."""
    x = F.when(v.sign > 0, v.ln).when(v.sign == 0, F.lit(NEG_INF))
    return Value(F.signum(x), X.ln(F.abs(x)))


def linear(v: Value) -> Column:
    return F.when(v.sign == 0, F.lit(0.0)).otherwise(v.sign * F.exp(v.ln))


def score(
    documents: DataFrame,
    queries: dict[str, Node],
    parameters: dict[str, dict[str, float]],
    n: int,
    text_bg: Background,
    entity_bg: Background | None = None,
    entity_length: bool = False,
) -> DataFrame:
    """The best ``n`` documents of each query and parameter set.

    documents: ``prepared`` or ``matched``, with any of archive, doc_name and entities (a map
    from an entity to its frequency). Returns query_id, param_set, rank, score,
    sign, ln_score, doc_id, doc (struct), entities, recorded_values.
    """
    frame = documents
    for name, kind in (("archive", "string"), ("doc_name", "string"), ("entities", "map<string,bigint>"), ("entity_len", "bigint")):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast(kind))
    frame = frame.withColumn("entities", F.coalesce("entities", F.create_map().cast("map<string,bigint>"))).withColumn("entity_len", F.coalesce("entity_len", F.lit(0)))
    if "_hits" not in frame.columns:
        frame = matched(frame, queries)
    frame = frame.select("doc_id", "archive", "doc_name", "doc_len", "entities", "entity_len", "_hits")
    outcomes = []
    for i, (query_id, node) in enumerate(sorted(queries.items())):
        keys, ents = sorted(KEY.join(t) for t in field_terms(node, "text")), sorted(e[0] for e in field_terms(node, "freebase_id"))
        matches = F.lit(False)
        if keys:
            matches = matches | _any_in("_hits", keys)
        if ents:
            matches = matches | _any_in(F.map_keys("entities"), ents)
        for j, (param_set, values) in enumerate(sorted(parameters.items())):
            compiler = Compiler(frame, f"_q{i}_{j}", values, text_bg, entity_bg or Background(0.0, unseen=0.05), entity_length)
            value, recorded = compiler.compile(node)
            frame = compiler.frame
            names = dict(recorded)
            entries = F.array(*(F.struct(F.lit(k).alias("key"), F.when(v.sign.isNotNull(), linear(v)).alias("value")) for k, v in names.items())) if names else F.array().cast("array<struct<key:string,value:double>>")
            outcomes.append(
                F.struct(
                    F.lit(query_id).alias("query_id"),
                    F.lit(param_set).alias("param_set"),
                    F.when(matches, value.sign).alias("sign"),
                    F.when(value.sign == 0, F.lit(NEG_INF)).otherwise(value.ln).alias("ln_score"),
                    F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("recorded_values"),
                    F.array(*map(F.lit, ents)).cast("array<string>").alias("_ents"),
                )
            )
    rows = frame.select("doc_id", F.struct("doc_name", "archive", F.col("doc_len").alias("length")).alias("doc"), F.col("entities").alias("_entities"), F.explode(F.array(*outcomes)).alias("o"))
    rows = rows.select("o.*", "doc_id", "doc", "_entities").where(F.col("sign").isNotNull() & ~F.isnan("sign"))
    ranked = rank(rows.withColumn("_order", F.struct("sign", F.when(F.col("sign") < 0, -F.col("ln_score")).otherwise(F.col("ln_score")))), n, ("query_id", "param_set"), "_order")
    entities = F.map_filter("_entities", lambda k, v: F.array_contains(F.col("_ents"), k))
    return ranked.select("query_id", "param_set", "rank", linear(Value(F.col("sign"), F.col("ln_score"))).alias("score"), "sign", "ln_score", "doc_id", "doc", entities.alias("entities"), "recorded_values")


def with_postings(results: DataFrame, docs: DataFrame, queries: dict[str, Node], text: str = "text") -> DataFrame:
    """``results`` with postings: where each of the query's terms and phrases stands in its document.

    Only documents that are in a ranking are read for their positions.
    ``docs`` has doc_id and the text.
    """
    ids = results.select("doc_id").distinct()
    # a ranking that has been cut is small: the texts stay where they are
    winners = docs.join(F.broadcast(ids) if ids.limit(WINNERS + 1).count() <= WINNERS else ids, "doc_id", "left_semi")
    terms = F.coalesce(X.streaming_terms(X.positioned(F.col(text))), F.array().cast("array<struct<term:string,token_pos:int,char_pos:struct<begin:int,end:int>>>"))
    vocabulary = set().union(*(field_terms(q, "text") for q in queries.values()))
    placed = winners.select("doc_id", terms.alias("_terms")).select("doc_id", positions(F.col("_terms"), vocabulary).alias("_found"))
    keys = lambda q: F.array(*(F.lit(KEY.join(t)) for t in sorted(field_terms(q, "text")))).cast("array<string>")
    wanted = F.create_map(*(x for name, q in sorted(queries.items()) for x in (F.lit(name), keys(q))))[F.col("query_id")]
    joined = results.join(placed, "doc_id", "left").withColumn("_keys", wanted)
    found = F.filter("_found", lambda x: F.array_contains(F.col("_keys"), x["key"]))
    postings = F.transform(F.filter(F.array_sort("_keys"), lambda k: F.exists("_found", lambda x: x["key"] == k)), lambda k: F.struct(k.alias("term"), F.transform(F.filter(found, lambda x: x["key"] == k), lambda x: x["position"]).alias("positions")))
    return joined.withColumn("postings", F.coalesce(postings, F.array().cast("array<struct<term:string,positions:array<struct<token_pos:int,char_pos:struct<begin:int,end:int>>>>>"))).drop("_found", "_keys")


# --- results -----------------------------------------------------------------------------

DOCUMENT = "struct<doc_name:string,length:bigint,archive:string,score:double,postings:array<struct<term:string,positions:array<struct<token_pos:int,char_pos:struct<begin:int,end:int>>>>>,entities:map<string,bigint>,recorded_values:map<string,double>>"


def results_json(results: DataFrame) -> DataFrame:
    """One row: ``{query: {parameter set: [document, ...]}}``; for results with postings that have been cut."""
    doc = F.struct(F.col("doc.doc_name").alias("doc_name"), F.col("doc.length").alias("length"), F.col("doc.archive").alias("archive"), "score", "postings", "entities", "recorded_values")
    per = results.groupBy("query_id", "param_set").agg(F.array_sort(F.collect_list(F.struct("rank", F.to_json(doc).alias("json")))).alias("docs"))
    line = lambda k, v: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), v)
    per = per.select("query_id", "param_set", line(F.col("param_set"), F.concat(F.lit("["), F.array_join(F.transform("docs", lambda d: d["json"]), ","), F.lit("]"))).alias("v"))
    per = per.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("v"))
    per = per.select(line(F.col("query_id"), F.concat(F.lit("{"), F.col("v"), F.lit("}"))).alias("v"))
    return per.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("v")), ","), F.lit("}")).alias("value"))


def write_results(results: DataFrame, path: str) -> None:
    results_json(results).coalesce(1).write.option("compression", "gzip").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """query_id, param_set, rank and the document's fields, of what ``write_results`` wrote."""
    whole = spark.read.option("wholetext", "true").text(path)
    parsed = whole.select(F.from_json("value", f"map<string,map<string,array<{DOCUMENT}>>>").alias("m"))
    sets = parsed.select(F.explode("m").alias("query_id", "sets")).select("query_id", F.explode("sets").alias("param_set", "docs"))
    return sets.select("query_id", "param_set", F.posexplode("docs").alias("rank", "d")).select("query_id", "param_set", (F.col("rank") + 1).alias("rank"), "d.*")
