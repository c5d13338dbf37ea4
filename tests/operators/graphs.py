"""Small graphs for tests: {function: [call, ...]}, a call being (label, target) or a dict."""

FUNCTIONS = "sym string, label string, file string, sl int, sc int"
CALLS = "caller string, ord int, target_tag string, target string, label string, callsite string, resolution string"
CANDIDATES = "caller string, ord int, cand_ord int, target string, label string"


def load(spark, graph, labels=None):
    """(functions, calls with expand, candidates)."""
    from pyspark.sql import functions as F

    from treewright.operators.build import expansion_flags

    labels = labels or {}
    functions, calls, candidates = [], [], []
    for line, (name, made) in enumerate(graph.items()):
        functions.append((name, labels.get(name, f"{name}()"), "a.rs", line, 0))
        for k, c in enumerate(made):
            c = c if isinstance(c, dict) else {"label": c[0], "target": c[1]}
            options = c.get("options")
            resolution = c.get("resolution") or ("complete" if options else None)
            tag = c.get("tag") or ("dynamic" if resolution else "direct")
            calls.append((name, k, tag, c.get("target"), c["label"], f"s{k}", resolution))
            candidates += [(name, k, n, t, text) for n, (text, t) in enumerate(options or [])]
    rows = spark.createDataFrame(calls, CALLS) if calls else spark.createDataFrame([], CALLS)
    key = F.when(F.col("target_tag").isin("direct", "dynamic"), F.concat_ws("|", "target", "resolution"))
    return spark.createDataFrame(functions, FUNCTIONS), expansion_flags(rows, key=key), spark.createDataFrame(candidates, CANDIDATES)
