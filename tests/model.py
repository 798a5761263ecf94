"""A log interpreted row by row, to hold the operators against."""

import random

from versionlog.model import DELETE, MERGE, PUT, RANGE_DELETE, SINGLE_DELETE


def u64(n):
    return (n % (1 << 64)).to_bytes(8, "little")


def random_log(seed, n=120, keys=8, append=False):
    """Rows (cf_id, key, seq, op, value, end_key) with the mix of a stress run."""
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        op = rng.choices([PUT, DELETE, SINGLE_DELETE, RANGE_DELETE, MERGE], [30, 10, 3, 5, 20])[0]
        k = rng.randrange(keys)
        key, end = b"k%02d" % k, None
        value = None
        if op in (PUT, MERGE):
            value = rng.choice([b"", b"a", b"bc", b"d"]) if append else u64(rng.randrange(1 << 63))
        if op == RANGE_DELETE:
            end = b"k%02d" % (k + rng.randrange(-1, 4))
        rows.append((rng.randrange(2), key, seq, op, value, end))
    return rows


def interpret(rows, snapshot=None, append=False):
    state, seqs = {}, {}
    for cf, key, seq, op, value, end in sorted(rows, key=lambda r: r[2]):
        if snapshot is not None and seq > snapshot:
            break
        at = (cf, key)
        if op == PUT:
            state[at] = value
        elif op in (DELETE, SINGLE_DELETE):
            state.pop(at, None)
        elif op == RANGE_DELETE:
            for other in [k for k in state if k[0] == cf and key <= k[1] < end]:
                del state[other]
        elif op == MERGE and append:
            old = state.get(at)
            parts = [p for p in (old, value) if p]
            state[at] = b",".join(parts)
        elif op == MERGE:
            state[at] = u64(int.from_bytes(state.get(at) or u64(0), "little") + int.from_bytes(value, "little"))
        seqs[at] = seq
    return state


def frame(spark, rows):
    from versionlog.model import OPLOG

    return spark.createDataFrame([(cf, k, s, op, v, e, s, 0, None) for cf, k, s, op, v, e in rows], OPLOG)


def collected(state):
    return {(r.cf_id, bytes(r.key)): bytes(r.value) for r in state.select("cf_id", "key", "value").collect()}
