"""Hypothesis properties of the keyed diff and of the change apply."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from depotlens.operators import snapshots as S
from depotlens.streaming import cdc

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
T = dt.datetime(2024, 1, 1)

rows = st.dictionaries(st.integers(0, 12), st.tuples(st.one_of(st.none(), st.integers(-3, 3)),
                                                      st.one_of(st.none(), st.sampled_from(["a", "b"]))),
                       max_size=10)


@SETTINGS
@given(old=rows, new=rows)
def test_apply_diff_rebuilds_new(spark, old, new):
    schema = "k long, x long, s string"
    o = spark.createDataFrame([(k, *v) for k, v in old.items()], schema)
    n = spark.createDataFrame([(k, *v) for k, v in new.items()], schema)
    d = S.diff(o, n, ["k"])
    ops = {r["k"]: r["op"] for r in d.collect()}
    for k in set(old) | set(new):
        expect = ("insert" if k not in old else "delete" if k not in new
                  else "update" if old[k] != new[k] else None)
        assert ops.get(k) == expect
    rebuilt = S.apply_diff(o, d, n, ["k"])
    assert sorted(map(tuple, rebuilt.collect())) == sorted(map(tuple, n.collect()))


changes = st.lists(st.tuples(st.integers(0, 5), st.sampled_from("IUD"), st.integers(0, 9)),
                   min_size=1, max_size=25)


@SETTINGS
@given(chs=changes, cuts=st.lists(st.integers(0, 25), max_size=3), replay=st.booleans())
def test_any_split_and_replay_equals_one_batch(spark, chs, cuts, replay):
    feed = [(i + 1, "orders.orders", k, op, float(v), T) for i, (k, op, v) in enumerate(chs)]

    def df(part):
        return spark.createDataFrame(part, cdc.CHANGE_SCHEMA)
    whole = cdc.visible(cdc.apply_changes(cdc.empty_state(spark), df(feed)))
    bounds = sorted({min(c, len(feed)) for c in cuts} | {0, len(feed)})
    parts = [feed[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    if replay:
        parts = parts + parts[:1]          # an old batch delivered again, late
    state = cdc.empty_state(spark)
    for p in parts:
        state = cdc.apply_changes(state, df(p))
    assert sorted(map(tuple, cdc.visible(state).collect()), key=str) == \
        sorted(map(tuple, whole.collect()), key=str)
