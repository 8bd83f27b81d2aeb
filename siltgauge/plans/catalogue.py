"""Queries over the driver's tables: every relational operator on data that has its shape.

Each query reads whole tables; limits are rescaled to the data, as the tables hold no source
code. The SQL beside each states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clones, dead, graph, rules, score
from ..reports import tsv_lines
from ..sources.files import measure, nesting, nesting_by_window
from ..thresholds import NORMAL, RELAXED, STRICT, Limits

TAGS = "ul|li|div|nav|a|h1|article|footer"
OPENING, CLOSING = rf"<(?:{TAGS})(?: [^>]*)?>", rf"</(?:{TAGS})>"
RISKY = "[A-Za-z0-9_.]@[A-Za-z0-9]|password|secret|token|licen[cs]e"
BLANK = r"[ \t\n\f\r;]+"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _count(text: str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("bigint")


def _found(facts: DataFrame, rule: Column, *keep: str) -> DataFrame:
    """Rows where the rule fires, its finding as f.

    No filter on the rule: that moves below the facts, which are then computed anew for every part
    of the rule that names them, and inside its lambdas for every item.
    """
    return facts.select(*keep, F.explode(F.filter(F.array(rule), lambda f: f.isNotNull())).alias("f"))


def _fired(facts: DataFrame, rule: Column, *keep: str) -> DataFrame:
    return _found(facts, rule, *keep).select(*keep, "f.kind", "f.severity", "f.confidence")


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the facts that several rules read, from one scan."""
    text = F.coalesce("text", F.lit(""))
    docs = measure(_read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text"), "lang", "source"))
    short = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) < 30)).cast("bigint")
    return docs.select(
        "path", "lang", "source", "line_count", "size_bytes", short.alias("comment_line_count"), _count("text", RISKY).alias("dangerous_pattern_count"),
        _count("text", "[?!;:,]").alias("branch_count"), _count("text", r"\.").alias("function_count"), F.lit(0).alias("class_count"), F.lit(0).alias("impl_block_count"),
    )


DOC_LIMITS = NORMAL.but(line_count=25, dangerous_pattern=1, branch_density=2)


def document_findings(spark: SparkSession, sf_dir: str, limits: Limits = DOC_LIMITS) -> DataFrame:
    """Row rules in one projection, unreferenced documents and clones, as one table of findings."""
    facts = document_facts(spark, sf_dir)
    rows = rules.run_rules(facts, limits)
    loose = facts.select("path", F.col("path").alias("module_path"), "line_count", "size_bytes", F.lit(0).alias("fan_in"), F.lit(False).alias("is_entry_point"), F.lit(False).alias("is_package_init"))
    named = _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("module_path"))
    unreferenced = dead.dead_weight(loose, named, ladder=(50, 25))
    copies = clones.clone_findings(_clones(spark, sf_dir, F.regexp_replace("text", BLANK, "")))
    return rows.unionByName(unreferenced).unionByName(copies)


def _clones(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    bodies = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("body").alias("name"), "text")
    return clones.clone_groups(bodies, key)


def corpus_scan(spark, sf_dir):
    return measure(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def corpus_totals(spark, sf_dir):
    return score.totals(document_facts(spark, sf_dir), "source", "lang")


def context_bomb(spark, sf_dir):
    return _fired(document_facts(spark, sf_dir), rules.context_bomb(NORMAL.but(line_count=25)), "path", "line_count", "size_bytes")


def branch_density(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", _count("html", "<li").alias("branch_count"), _count("html", "<ul").alias("function_count"))
    return _fired(pages, rules.branch_density(NORMAL.but(branch_density=3)), "page_id", "branch_count", "function_count")


def deep_nesting(spark, sf_dir):
    depth = nesting(_read(spark, sf_dir, "pages"), "page_id", "html", OPENING, CLOSING).withColumnRenamed("max_depth", "max_nesting_depth")
    return _fired(depth, rules.deep_nesting(NORMAL.but(nesting_depth=3)), "page_id", "max_nesting_depth")


def nesting_window(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("delta"))
    return nesting_by_window(lines, "l_orderkey", "place", "delta")


def type_complexity(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("max_type_depth"))
    return _fired(parts, rules.type_complexity(NORMAL.but(type_depth=44)), "p_partkey", "max_type_depth")


def comment_ratio(spark, sf_dir):
    return _fired(document_facts(spark, sf_dir), rules.comment_ratio(NORMAL), "path", "comment_line_count", "line_count")


def implicit_control(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", _count("html", '[a-z]="').alias("decorator_count"), _count("html", "<[a-z]").alias("function_count"), F.col("url").contains("//blog.").alias("blog"))
    return _fired(pages, rules.implicit_control(NORMAL.but(decorator_density=0.10), framework=F.col("blog")), "page_id", "decorator_count", "function_count")


def error_swallow(spark, sf_dir):
    errors = _read(spark, sf_dir, "events").where("event_type = 'error'")
    weeks = errors.groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("empty_catch_count"))
    return _fired(weeks, rules.error_swallow(NORMAL.but(empty_catch=1)), "user_id", "week", "empty_catch_count")


def dangerous_pattern(spark, sf_dir):
    return _fired(document_facts(spark, sf_dir), rules.dangerous_pattern(NORMAL.but(dangerous_pattern=1)), "path", "dangerous_pattern_count")


def stringly_typed(spark, sf_dir):
    orders = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("string_comparison_count"))
    return _fired(orders, rules.stringly_typed(NORMAL.but(string_comparison=2)), "l_orderkey", "string_comparison_count")


def import_diversity(spark, sf_dir):
    orders = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("/x"))).alias("imports"))  # an order has few lines
    return _fired(orders.withColumn("n_domains", F.size("imports").cast("bigint")), rules.import_diversity(NORMAL.but(import_domain=4)), "l_orderkey", "n_domains")


def import_domains(spark, sf_dir):
    spec = F.regexp_replace("url", "^[a-z]+://", "")
    return _read(spark, sf_dir, "pages").groupBy(S.import_domain(spec).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def naming_entropy(spark, sf_dir):
    n = (F.col("p_size") % 6).cast("int")
    forms = [F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_type", F.lit(" "), F.lit("_")), F.regexp_replace("p_brand", "#", "")]
    made = [F.concat(f, F.lit("_" if k < 2 else "N")) for k, f in enumerate(forms)]
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(*[F.concat(m, i.cast("string")) for m in made])))
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.when(n > 0, each).otherwise(F.array().cast("array<string>")).alias("identifiers"))
    return _fired(parts.withColumn("n_identifiers", F.size("identifiers").cast("bigint")), rules.naming_entropy(), "p_partkey", "n_identifiers")


def classify_names(spark, sf_dir):
    names = _read(spark, sf_dir, "part").select(F.explode(F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_type", F.lit(" "), F.lit("_")), F.regexp_replace("p_brand", "#", ""), "p_name", F.lit("xY"))).alias("name"))
    return names.groupBy(S.classify_identifier(F.col("name")).alias("convention")).agg(F.count(F.lit(1)).alias("n"))


def reexport_entropy(spark, sf_dir):
    entry = F.struct(F.lit("x").alias("source"), F.col("l_quantity").cast("int").alias("item_count"), (F.col("l_returnflag") == "R").alias("is_wildcard"))
    orders = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("exports"))  # an order has few lines
    return _fired(orders.withColumn("n_exports", F.size("exports").cast("bigint")), rules.reexport_entropy(NORMAL.but(reexport=100)), "l_orderkey", "n_exports")


def unused_import(spark, sf_dir):
    """Long words as imported names, words before a full stop as identifiers."""
    low = F.lower(F.coalesce("text", F.lit("")))
    names = F.regexp_extract_all(low, F.lit("[a-z]{9,}"), F.lit(0))
    facts = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), names.alias("imported_names"), F.regexp_extract_all(low, F.lit(r"(?<![a-z])([a-z]++)\."), F.lit(1)).alias("identifiers"))
    rule = rules.unused_import(least=2, medium=5, compiler_names=("something", "anonymous"))
    return _found(facts, rule, "path").select("path", "f.kind", "f.severity", "f.confidence", F.col("f.evidence")["unused_count"].cast("bigint").alias("unused_count"), F.col("f.evidence")["preview"].alias("preview"))


def dominant_convention(spark, sf_dir):
    """Words of texts as identifiers: which conventions mix, and which leads."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z_]+"), F.lit(0))
    found = _found(_read(spark, sf_dir, "documents").select("doc_id", words.alias("identifiers")), rules.naming_entropy(conventions=2), "doc_id")
    return found.select("doc_id", "f.severity", F.col("f.evidence")["dominant_convention"].alias("dominant"), F.col("f.evidence")["mixed_count"].cast("bigint").alias("mixed"))


def _bodies(spark, sf_dir):
    body = F.concat(F.lit("const "), "p_name", F.lit(" = new "), "p_type", F.lit("( "), "p_brand", F.lit(" );\n  if (this) return "), "p_name", F.lit(";"))
    return _read(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


def body_keys(spark, sf_dir):
    """Bodies stripped, and as Type-2 keys with all names but keywords blanked."""
    return _bodies(spark, sf_dir).select("p_partkey", S.strip_body(F.col("body")).alias("plain"), S.blank_identifiers(F.col("body")).alias("type2"), S.is_test_name(F.col("body"), ("widget", "gear")).alias("named_test"))


ENDINGS = (".ts", ".test.ts", "/tests/x.py", ".spec.jsx", "_test.rs", "/conftest.py", "/vite.config.ts", "/jestHelpers.ts", "/.eslintrc.cjs", "/build.py")
IMPORTS = ("lodash", "@nestjs/core", "@angular/core", "dataclasses", "typing_extensions", "react")


def path_predicates(spark, sf_dir):
    """Which paths are tests or configuration, and which imports are those of a framework."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    part = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), pick(ENDINGS)).alias("path"), F.array(F.lit("x"), pick(IMPORTS)).alias("imports"))
    heavy = {f"heavy_{k}": S.is_framework_heavy(F.col("imports"), F.lit(k)) for k in ("typescript", "python")}
    return part.select("p_partkey", "path", S.is_test_path(F.col("path")).alias("is_test"), S.is_config_path(F.col("path")).alias("is_config"), *[v.alias(k) for k, v in heavy.items()])


def report_words(spark, sf_dir):
    """Names, bars and labels of reports."""
    part, size = _read(spark, sf_dir, "part"), F.col("p_size")
    share = size / 50
    return part.select(
        "p_partkey", S.kebab(F.concat(F.initcap(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1)), F.lit("_"), "p_type")).alias("kebab"),
        S.severity_name(F.col("p_type")).alias("severity"), S.score_bar(size * 2).alias("bar"), S.score_bar(size * 2, rounded=False).alias("bar_floor"),
        S.score_level(size * 2).alias("level"), S.instability_label(share).alias("label"), S.module_path(F.concat(F.lit("a/src/x/"), "p_type", F.lit("/index.ts"))).alias("module"),
    )


def unused_names(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))
    return rules.unused_names(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", medium=60)


def _supply(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    nodes = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    pairs = lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src_path"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return nodes, pairs


def degrees_edges(spark, sf_dir):
    nodes, pairs = _supply(spark, sf_dir)
    return graph.with_instability(graph.degrees(nodes, graph.edges_of(pairs, distinct=False)))


def degrees_distinct(spark, sf_dir):
    nodes, pairs = _supply(spark, sf_dir)
    return graph.with_instability(graph.degrees(nodes, graph.edges_of(pairs)))


def coupling_hotspot(spark, sf_dir):
    """Parts and suppliers, linked by all of lineitem."""
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    edges = graph.edges_of(_read(spark, sf_dir, "lineitem").select(part.alias("src_path"), supplier.alias("dst")))
    nodes = _read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("path"))
    nodes = nodes.union(_read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"))))
    return _fired(graph.degrees(nodes, edges), rules.coupling_hotspot(NORMAL.but(fan_in=515, fan_out=30)), "path", "fan_in", "fan_out")


def dead_weight(spark, sf_dir):
    return document_findings(spark, sf_dir).where("kind = 'dead-weight'").select("path", "kind", "severity", "confidence", "estimated_tokens")


def clones_exact(spark, sf_dir):
    return _clones(spark, sf_dir, F.regexp_replace("text", BLANK, "")).select("digest", "n_paths", "n_bodies", "path", F.array_join("paths", ",").alias("paths"))


def clones_type2(spark, sf_dir):
    key = F.regexp_replace(F.regexp_replace("text", "[A-Za-z]+", "_"), BLANK, "")
    return _clones(spark, sf_dir, key).select("digest", "n_paths", "n_bodies", "path", F.array_join("paths", ",").alias("paths"))


def _hosts(spark, sf_dir):
    host = F.reverse(F.split(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), r"\."))
    return _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("src_path"), F.array_join(host, ".").alias("spec"), F.array_join(F.slice(host, 1, 3), ".").alias("module_path"))


def prefix_resolve(spark, sf_dir):
    hosts = _hosts(spark, sf_dir)
    return graph.resolve_prefix(hosts.select("src_path", "spec"), hosts.select("module_path", F.col("module_path").alias("path")))


def prefix_resolve_strict(spark, sf_dir):
    """Hosts by their first two labels, where what lies below a match must be known too."""
    hosts = _hosts(spark, sf_dir).select("src_path", "spec", F.substring_index("module_path", ".", 2).alias("short"), "module_path")
    known = hosts.select(F.col("short").alias("module_path"), F.col("short").alias("path")).union(hosts.where("length(spec) > 22").select("module_path", "module_path"))
    return graph.resolve_prefix(hosts.select("src_path", "spec"), known, strict_chain=True)


def prefix_resolve_scoped(spark, sf_dir):
    """Hosts resolved among pages of the same language folder only."""
    folder = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    hosts = _hosts(spark, sf_dir).join(_read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("src_path"), folder.alias("package")), "src_path")
    known = hosts.select("package", "module_path", F.concat_ws("/", "package", "module_path").alias("path"))
    return graph.resolve_prefix(hosts.select("package", "src_path", "spec"), known, scoped=True)


def referenced_closure(spark, sf_dir):
    return graph.referenced_closure(_hosts(spark, sf_dir), "spec", ".")


def relative_resolve(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".ts"), F.lit(".tsx"), F.lit("/index.ts")), (F.col("p_size") % 3 + 1).cast("int"))
    stem = F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    part = _read(spark, sf_dir, "part").select("p_partkey", stem.alias("stem"), F.concat(stem, ending).alias("path"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("../"), F.col("stem")).alias("up"))
    flat = part.where(~F.col("path").contains("/index."))
    return graph.resolve_relative(flat.join(after, "p_partkey").select(F.col("path").alias("src_path"), F.col("up").alias("spec")), part)


def evidence_parse(spark, sf_dir):
    lines = F.array(F.concat(F.lit("chars: "), F.coalesce(F.col("n_chars").cast("string"), F.lit(""))), F.concat(F.lit("pair: a: "), F.coalesce("source", F.lit(""))), F.lit("no separator"))
    found = _read(spark, sf_dir, "documents").select("doc_id", S.evidence_map(lines).alias("m"))
    return found.select("doc_id", F.col("m")["chars"].alias("chars"), F.col("m")["pair"].alias("pair"), F.size("m").cast("bigint").alias("n"))


def findings_all(spark, sf_dir):
    return document_findings(spark, sf_dir).select("path", "kind", "severity", "confidence", "estimated_tokens")


def ranked_findings(spark, sf_dir):
    return score.ranked(document_findings(spark, sf_dir)).select("id", "path", "kind", "severity")


def kind_severity_pivot(spark, sf_dir):
    return score.by_kind(document_findings(spark, sf_dir))


def topk_per_kind(spark, sf_dir):
    return score.top_per_kind(document_findings(spark, sf_dir)).select("kind", "path", "severity", F.col("nth").cast("bigint").alias("nth"), "more")


def priority_targets(spark, sf_dir):
    return score.priorities(document_findings(spark, sf_dir)).select("kind", "path", "severity")


def global_score(spark, sf_dir):
    n, tokens = score.totals(document_facts(spark, sf_dir)).select("n_files", "total_tokens").first()
    return score.global_score(document_findings(spark, sf_dir), n, tokens or 0)


def score_rollup(spark, sf_dir):
    return score.score_rollup(document_findings(spark, sf_dir))


def profile_compare(spark, sf_dir):
    facts = document_facts(spark, sf_dir)
    sides = [(name, rules.run_rules(facts, limits.but(line_count=limits.line_count // 20))) for name, limits in (("strict", STRICT), ("relaxed", RELAXED))]
    return score.compare(*sides)


def report_tsv(spark, sf_dir):
    return tsv_lines(score.ranked(document_findings(spark, sf_dir)))


def explain_largest(spark, sf_dir):
    """Facts and flags of the documents of greatest size."""
    facts = document_facts(spark, sf_dir)
    most = facts.agg(F.max("size_bytes").alias("most"))
    return facts.join(F.broadcast(most), F.col("size_bytes") == F.col("most")).select("path", "line_count", "size_bytes", "comment_line_count", "branch_count", "function_count")


NAMES = (
    "corpus_scan corpus_totals context_bomb branch_density deep_nesting nesting_window type_complexity comment_ratio implicit_control error_swallow dangerous_pattern stringly_typed "
    "import_diversity import_domains unused_import dominant_convention body_keys path_predicates report_words naming_entropy classify_names reexport_entropy unused_names degrees_edges degrees_distinct coupling_hotspot dead_weight clones_exact clones_type2 prefix_resolve prefix_resolve_strict prefix_resolve_scoped "
    "referenced_closure relative_resolve evidence_parse findings_all ranked_findings kind_severity_pivot topk_per_kind priority_targets global_score score_rollup profile_compare report_tsv explain_largest"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in NAMES}
