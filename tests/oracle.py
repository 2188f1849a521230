"""Runs a registered query and its SQL twin and compares rows, columns and values."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def typename(v):
    return type(v).__name__


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    rows = df.collect()
    t1 = time.time()
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
    if sql is None:
        return None, f"rows-only n={len(rows)} spark={t1 - t0:.1f}s"
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    raw = cur.fetchall()
    t2 = time.time()
    if sorted(dcols) != cols:
        return False, f"columns {cols} vs {sorted(dcols)}"
    idx = [dcols.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in raw)
    note = f"n={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    for c, i in zip(cols, idx):
        a = {typename(r[c]) for r in rows if r[c] is not None}
        b = {typename(r[i]) for r in raw if r[i] is not None}
        if a and b and a != b:
            return False, f"{note} type of {c}: {a} vs {b}"
    if got != want:
        only_g = [g for g in got if g not in set(want)][:2]
        only_w = [w for w in want if w not in set(got)][:2]
        return False, f"{note} duck n={len(want)} cols={cols}\n   spark {str(only_g)[:600]}\n   duck  {str(only_w)[:600]}"
    return True, note


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from corvane.session import local_session

    sf = sys.argv[1]
    pats = sys.argv[2:]
    spark = local_session("8")
    con = duck(sf)
    Q, O = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in Q.items():
        if pats and not any(name.startswith(p) for p in pats):
            continue
        try:
            ok, note = compare(spark, con, name, fn, O.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, note, flush=True)
    print("failures:", bad)
