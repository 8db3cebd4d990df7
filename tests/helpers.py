import itertools
import json
import os

_order = itertools.count(1_700_000_000)


def land(folder, lines, name):
    """Write a message file whose time stamp is later than that of all files before."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.writelines(line + "\n" for line in lines)
    stamp = next(_order)
    os.utime(path, (stamp, stamp))


def message(symbol, time, close=1.0, **changed):
    fields = {"symbol": symbol, "open": close, "high": close, "low": close, "close": close}
    return json.dumps({**fields, "timestamp": time, **changed})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
