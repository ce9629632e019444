"""Times of single-process pandas versions of headline queries, as a measure for bench.py: python baseline.py prints one JSON line.

Every version reads its Parquet columns anew and gives the rows that the query gives; it is no part of the library.
"""

import json
import os
import re
import time

import numpy as np
import pandas as pd

from tidemark.operators.evidence import STOPWORDS

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def read(name, *columns):
    return pd.read_parquet(f"{D}/{name}.parquet", columns=list(columns) or None)


def ask_spec_topn():
    e = read("exposure", "load_no", "nuts_id", "region", "country", "exposed_pop", "total_pop", "return_period").query("return_period == 100 and country == 'XD'")
    e["s"] = e.exposed_pop / e.total_pop.where(e.total_pop != 0)
    return e[e.s <= 1].sort_values(["s", "load_no", "nuts_id"], ascending=[False, True, True]).head(5)


def ask_null_excluded():
    e = read("exposure", "poverty_rate_pct", "exposed_pop", "return_period").query("return_period == 500")
    keep = (e.poverty_rate_pct >= 10) & e.exposed_pop.notna()
    return keep.sum(), (e.poverty_rate_pct.isna() & ~keep).sum()


def scenario_summary():
    return read("exposure", "load_no", "return_period", "exposed_pop").groupby(["load_no", "return_period"]).exposed_pop.agg(["size", "count", "sum"])


def level_coverage_outer():
    o, c = read("orders", "o_custkey", "o_totalprice"), read("customer", "c_custkey", "c_nationkey")
    p = o.merge(c, left_on="o_custkey", right_on="c_custkey").groupby("c_nationkey").o_totalprice.sum()
    li, s = read("lineitem", "l_suppkey", "l_extendedprice"), read("supplier", "s_suppkey", "s_nationkey")
    k = li.groupby("l_suppkey").l_extendedprice.sum().reset_index().merge(s, left_on="l_suppkey", right_on="s_suppkey").groupby("s_nationkey").l_extendedprice.agg(["sum", "size"])
    return pd.concat([p, k], axis=1)


def trapezoid_expected_exposure():
    e = read("exposure", "load_no", "nuts_id", "return_period", "annual_probability", "exposed_pop").drop_duplicates().sort_values(["load_no", "nuts_id", "annual_probability"])
    g = e.groupby(["load_no", "nuts_id"], dropna=False)
    e["area"] = (e.exposed_pop + g.exposed_pop.shift()) / 2 * (e.annual_probability - g.annual_probability.shift())
    return e.groupby(["load_no", "nuts_id"], dropna=False).agg(n=("area", "size"), gaps=("exposed_pop", lambda x: x.isna().sum()), area=("area", "sum"), low=("annual_probability", "min"), high=("annual_probability", "max"), last=("exposed_pop", "last"))


def composite_index():
    names, w = ["share_over_65", "share_low_income", "poverty_rate_pct"], np.array([1.0, 2.0, 1.0])
    u = read("vulnerability_units", "request_id", "lau_id", "computed_at", *names).drop_duplicates()
    g = u.groupby("request_id")[names]
    low, high = g.transform("min"), g.transform("max")
    s = ((u[names] - low) / (high - low).where(high > low)).clip(0, 1).where(high > low, 0).where(u[names].notna())
    return (s * w).sum(axis=1) / (s.notna() * w).sum(axis=1)


def quartiles_with_min_points():
    return read("lineitem", "l_suppkey", "l_extendedprice").groupby("l_suppkey").l_extendedprice.quantile([0.25, 0.5, 0.75])


def ensemble_sign_agreement():
    p = read("pluvial", "nuts_id", "release_no", "pluvial_rx5day_change_pct_gwl2_0_p50", "pluvial_extreme_precip_days_change_pct_gwl2_0_p50").drop_duplicates()
    v = p.pluvial_rx5day_change_pct_gwl2_0_p50
    p["v"] = v.where(v.between(-80, 150))
    g = p.groupby("nuts_id").v
    return g.quantile([0.25, 0.5, 0.75]), g.agg(["min", "max", "count"])


def confusion_by_unit():
    li = read("lineitem", "l_suppkey", "l_quantity", "l_discount")
    m, o = li.l_quantity / 10 > 2.5, li.l_discount * 100 > 5
    return pd.DataFrame({"k": li.l_suppkey, "h": m & o, "x": ~m & o, "f": m & ~o}).groupby("k").sum()


def sen_slope():
    o = read("orders", "o_custkey", "o_totalprice", "o_orderdate")
    m = o.groupby(["o_custkey", o.o_orderdate.dt.year.rename("y")]).o_totalprice.max().reset_index()
    p = m.merge(m, on="o_custkey")
    p = p[p.y_y > p.y_x]
    p["slope"], p["sign"] = (p.o_totalprice_y - p.o_totalprice_x) / (p.y_y - p.y_x), np.sign(p.o_totalprice_y - p.o_totalprice_x)
    return p.groupby("o_custkey").agg(slope=("slope", "median"), s=("sign", "sum"))


def quantile_classes():
    o = read("orders", "o_orderpriority", "o_totalprice")
    out = []
    for k, g in o.groupby("o_orderpriority").o_totalprice:
        v = np.sort(g.to_numpy())
        b = np.unique(v[np.maximum(np.ceil(np.arange(1, 7) / 6 * len(v)).astype(int) - 1, 0)])
        out.append((k, np.bincount(np.minimum(np.searchsorted(b, v), len(b) - 1))))
    return out


def group_country_sets():
    li, p, s = read("lineitem", "l_partkey", "l_suppkey", "l_quantity"), read("part", "p_partkey", "p_brand"), read("supplier", "s_suppkey", "s_nationkey")
    q = li.merge(p, left_on="l_partkey", right_on="p_partkey").merge(s, left_on="l_suppkey", right_on="s_suppkey").groupby(["p_brand", "s_nationkey"]).l_quantity.sum()
    return q[q >= 500].reset_index().merge(read("nation", "n_nationkey", "n_name"), left_on="s_nationkey", right_on="n_nationkey").groupby("p_brand").n_name.apply(sorted)


def tokens_and_df():
    stop, word = set(STOPWORDS), re.compile(r"[^\W_]{3,}")
    n, df = {}, {}
    for text in read("documents", "text").text:
        found = [w for w in word.findall((text or "").lower()) if w not in stop]
        for w in found:
            n[w] = n.get(w, 0) + 1
        for w in set(found):
            df[w] = df.get(w, 0) + 1
    return n, df


def hourly_tumbling():
    e = read("events", "ts", "event_type", "value")
    return e.groupby([e.ts.dt.floor("h"), "event_type"]).value.agg(["size", "sum", "max"])


def p2_found():
    f = read("fetch_results", "snapshot_no", "source_id", "bytes", "sha256", "fetched_at")
    f["source_id"], f["sha256"] = f.source_id.str.lower().str.strip(), f.sha256.str.lower()
    f = f.sort_values("fetched_at").drop_duplicates(["snapshot_no", "source_id"], keep="last")
    steps = dict(zip(sorted(f.snapshot_no.unique()), sorted(f.snapshot_no.unique())[1:]))
    old = f.assign(snapshot_no=f.snapshot_no.map(steps)).dropna(subset=["snapshot_no"])
    m = f.merge(old, on=["snapshot_no", "source_id"], how="outer", indicator=True)
    same = (m.bytes_x.eq(m.bytes_y) | m.bytes_x.isna() & m.bytes_y.isna()) & (m.sha256_x.eq(m.sha256_y) | m.sha256_x.isna() & m.sha256_y.isna())
    return m[(m._merge != "both") | ~same]


def p4_found():
    p = read("passages", "passage_id", "text").drop_duplicates("passage_id")
    ends = re.compile("[.!?…][)\\]\"”’»']*(?= [(\\[\"“‘«']*[^\\W\\d_a-zß-öø-ÿ])")
    words = [" ".join(t.split()) for t in p.text.fillna("")]
    longest = lambda w: max(len(s) for s in ends.split(w))
    return [(i, longest(w) > 900) for i, w in zip(p.passage_id, words) if len(w) > 900]


def p6_found():
    d = read("documents", "doc_id", "text")
    return d.doc_id[d.text.fillna("").str.encode("utf-8").str.len() > 4_096]


VERSIONS = [ask_spec_topn, ask_null_excluded, scenario_summary, level_coverage_outer, trapezoid_expected_exposure, composite_index, quartiles_with_min_points, ensemble_sign_agreement, confusion_by_unit, sen_slope, quantile_classes, group_country_sets, tokens_and_df, hourly_tumbling, p2_found, p4_found, p6_found]


if __name__ == "__main__":
    VERSIONS[0]()
    times = {}
    for f in VERSIONS:
        began = time.perf_counter()
        f()
        times[f.__name__] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "pandas_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(D.rstrip("/"))}))
