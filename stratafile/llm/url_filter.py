"""URL filters: host rules, and a path-template tree of each host judged by labels. DataFrame operations only.

Tree: a path is split at /, its digits become #. From the top down, below each branch of already generalised segments, a segment that few urls
share beside many others becomes the wildcard *; so a branch has few children, whatever the number of urls. Segments that all paths of a branch have in common are passed in one step (the common start of the least
and the greatest path), and a path that is alone in its branch is at its end; so paths may be of any depth, and the steps are as many as branchings follow each other. The urls of a host with the same generalised segments are a template. From the
leaves up, a branch whose bad share among the labelled urls doesn't differ from that of its siblings together with it (a two-sided test of Z2, with continuity correction) is merged
into its parent, which is then tried in the same way; one that differs stands alone. A template belongs to the deepest branch that stands alone, or to its host's root. The purity of a branch is its bad share, smoothed by SMOOTH
urls of the host's share, itself smoothed by the share of all; a branch at REJECT or more is blocked.

All counting is done on distinct (host, generalised path) pairs after partial aggregation, so that no host's urls meet in one task; labels meet only the urls that name a document.

Defined cases: a null url, or one without ://, has an empty host and path and is judged by the share of its like; an empty path belongs to the root; repeated rows are judged alike; labels
may repeat (the worst counts) or be null (no label); branches without labels merge with their siblings; of two rules of the same length the later in code-point order wins; an empty table gives an
empty result; rows without a page_id are judged like others; urls of any length and paths of any depth are read whole; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A branch with more than MANY different segments takes those with less than one in RARE of its urls as values of a variable.
MANY, RARE = 20, 20
#: Judged paths that are broadcast at once; more meet the urls by a shuffle.
MOST_PATHS = 50_000
Z2, SMOOTH, REJECT = 3.8416, 10.0, 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """The lower-case host and the path of a url, both empty if it is null or has no ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, "host/path") rules that fits a host or subdomain of it and starts the path; its text and verdict, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # a longer one overrides
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        text, verdict = F.when(fits, r).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The path's segments, with every run of digits as #."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")


def common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def templates(counts: DataFrame) -> DataFrame:
    """counts (host, segs, n, ...), distinct by host and segs, with tpl and covered. n urls have this host and these segments.

    tpl: the branchings that the path takes, an element each: the segments that its branch has in common, and its own segment below them or a wildcard. covered: how many segments that are, element by element."""
    x = counts.withColumns({"tpl": F.array().cast("array<string>"), "covered": F.array().cast("array<int>"), "at": F.lit(0)})
    done: list[DataFrame] = []
    while True:
        rest = F.slice("segs", F.col("at") + 1, F.greatest(F.size("segs") - F.col("at"), F.lit(0)))
        ends = x.groupBy("host", "tpl").agg(F.min(rest).alias("low"), F.max(rest).alias("high"), F.count("*").alias("paths"))
        branch = ends.where("paths > 1").select("host", "tpl", common(F.col("low"), F.col("high")).alias("shared"))
        x = written(x.join(branch, ["host", "tpl"], "left").withColumn("seg", F.when(F.col("shared").isNotNull(), F.get("segs", F.col("at") + F.col("shared")))), "op9-templates")
        done.append(x.where("seg is null").select(*counts.columns, "tpl", "covered"))
        x = x.where("seg is not null")
        if not x.limit(1).count():
            break
        node = x.groupBy("host", "tpl", "seg").agg(F.sum("n").alias("k"))
        kinds = node.groupBy("host", "tpl").agg(F.sum("k").alias("all_"), F.count("*").alias("kinds"))
        rare = node.join(kinds, ["host", "tpl"]).where((F.col("kinds") > MANY) & (F.col("k") * RARE < F.col("all_"))).select("host", "tpl", "seg", F.lit("*").alias("wild"))
        step = F.array_join(F.concat(F.slice("segs", F.col("at") + 1, F.col("shared")), F.array(F.coalesce("wild", "seg"))), "/")
        x = x.join(rare, ["host", "tpl", "seg"], "left").withColumns({"step": step, "at": F.col("at") + F.col("shared") + 1})
        x = x.select(*counts.columns, F.concat("tpl", F.array("step")).alias("tpl"), F.concat("covered", F.array("at")).alias("covered"), "at")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def standing(named: DataFrame) -> DataFrame:
    """(host, node, labelled, bad): the branches that stand alone, and the roots. named: (host, tpl, labelled, bad)."""
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    own = written(named.groupBy("host", F.col("tpl").alias("node")).agg(*sums), "op9-leaves")
    deepest = own.agg(F.max(F.size("node"))).first()[0] or 0
    alone, up = [], None
    for d in range(deepest, 0, -1):
        at = own.where(F.size("node") == d)
        at = at if up is None else at.unionByName(up).groupBy("host", "node").agg(*sums)
        # a parent has at most max(MANY, RARE) children and a wildcard
        over = Window.partitionBy("host", F.slice("node", 1, d - 1))
        n = F.col("labelled").cast("double")
        at = at.withColumns({"p": F.try_divide(F.col("bad").cast("double"), n), "q": F.try_divide(F.sum("bad").over(over).cast("double"), F.sum("labelled").over(over).cast("double"))})
        gap = F.greatest(F.abs(F.col("p") - F.col("q")) - F.try_divide(F.lit(0.5), n), F.lit(0.0))
        at = written(at.withColumn("differs", F.coalesce(gap * gap * n > F.lit(Z2) * F.col("q") * (1 - F.col("q")), F.lit(False))), "op9-level")
        alone.append(at.where("differs").select("host", "node", "labelled", "bad"))
        up = at.where("not differs").groupBy("host", F.slice("node", 1, d - 1).alias("node")).agg(*sums)
    root = own.where(F.size("node") == 0)
    out = root if up is None else root.unionByName(up).groupBy("host", "node").agg(*sums)
    for x in alone:
        out = out.unionByName(x)
    return out


def judged(counts: DataFrame) -> DataFrame:
    """(host, segs, template, purity) from (host, segs, n, labelled, bad). template: the branch, ending in ** where the path's own template goes on below it."""
    named = written(templates(counts), "op9-named")
    alone = written(standing(named), "op9-branches")
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("h_n"), F.sum("bad").alias("h_bad"))
    t_n, t_bad = counts.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    of_host = (F.col("h_bad") + F.lit(SMOOTH * (t_bad / t_n if t_n else 0.0))) / (F.col("h_n") + SMOOTH)
    scored = alone.join(hosts, "host").select("host", "node", ((F.col("bad") + SMOOTH * of_host) / (F.col("labelled") + SMOOTH)).alias("purity"))
    ways = named.select("host", "tpl").distinct().withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.size("tpl")), lambda n: F.slice("tpl", F.lit(1), n))))
    found = ways.join(scored, ["host", "node"]).groupBy("host", "tpl").agg(F.max_by(F.struct("node", "purity"), F.size("node")).alias("of"))
    own = F.coalesce(F.get("covered", F.size("of.node") - 1), F.lit(0))
    text = F.concat(F.lit("/"), F.array_join("of.node", "/"), F.when(own < F.size("segs"), F.when(own == 0, "**").otherwise("/**")).otherwise(""))
    return named.select("host", "segs", "tpl", "covered").join(found, ["host", "tpl"]).select("host", "segs", text.alias("template"), "of.purity")


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, segs, n, labelled, bad) from rows (host, segs, doc) and labels (doc, bad)."""
    every = rows.groupBy("host", "segs").agg(F.count("*").alias("n"))
    marked = rows.where("doc is not null").groupBy("host", "segs", "doc").agg(F.count("*").alias("k")).join(labels, "doc")
    marked = marked.groupBy("host", "segs").agg(F.sum("k").alias("labelled"), F.sum(F.col("k") * F.col("bad")).alias("bad"))
    zero = F.lit(0).cast("long")
    return every.join(marked, ["host", "segs"], "left").withColumns({"labelled": F.coalesce("labelled", zero), "bad": F.coalesce(F.col("bad").cast("long"), zero)})


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", document: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), a row for each row of pages.

    labels: (doc_id, bad), bad 0, 1 or null. document: the doc_id behind a page; by default the first number in its path."""
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), *([document.alias("doc")] if document is not None else []))
    rows = rows.withColumn("segs", segments(F.col("path")))
    if document is None:
        rows = rows.withColumn("doc", F.regexp_extract("path", "[0-9]+", 0).try_cast("long"))
    labels = labels.where("bad is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.max("bad").alias("bad"))
    found = judged(written(counted(rows, labels), "op9-counts"))
    rows = rows.drop("doc").join(few(written(found, "op9-judged"), MOST_PATHS), ["host", "segs"])
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity")
