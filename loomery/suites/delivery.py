"""Delivery protocols over each user's log: views and clicks write, purchases commit, errors crash or abort, sign-ups replay or fence."""

from __future__ import annotations

from loomery.errors import Stopped
from loomery.operators import delivery as d
from loomery.operators.keyed import run_by_key
from loomery.suites.frames import frame
from loomery.suites.machines import DUCK_EVENTS


class _Epochs:
    """A purchase commits the open epoch, a sign-up replays the last commit, an error crashes."""

    def __init__(self):
        self.sink, self.epoch = d.EpochSink(), 0

    def step(self, seq, kind, v):
        if kind == "purchase":
            self.sink.commit(self.epoch)
            self.epoch += 1
        elif kind == "signup":
            if self.epoch:
                self.sink.commit(self.epoch - 1)
        elif kind == "error":
            self.sink.crash_recovery()
        else:
            self.sink.stage(self.epoch, v)
        return ()

    def finish(self):
        a = self.sink.audit()
        return [(a["published"], sum(self.sink.published), a["pending"], a["dropped"], a["replays"], a["epochs"])]


class _Files:
    """A purchase is a checkpoint over all staged names, an error a crash, a sign-up an attempt to publish too early."""

    def __init__(self):
        self.files, self.published = d.FileCommitter(), 0

    def step(self, kind, v):
        if kind == "purchase":
            self.published += self.files.commit_checkpoint(list(self.files.staged))
        elif kind == "error":
            self.files.recover()
        elif kind == "signup":
            try:
                self.files.finalize_before_checkpoint(v % 4)
            except Stopped:
                pass
        else:
            self.files.stage(v % 4, v)
        return ()

    def finish(self):
        return [(self.published, len(self.files.published), self.files.orphans, self.files.refused, len(self.files.staged))]


class _Drill:
    """Every error is a crash at its place of the tape."""

    def __init__(self):
        self.n, self.crashes = 0, set()

    def step(self, kind):
        if kind == "error":
            self.crashes.add(self.n)
        self.n += 1
        return ()

    def finish(self):
        first, then = (d.crash_drill(self.n, self.crashes, p) for p in ("commit_first", "process_first"))
        return [(self.n, first["records"], first["lost"], then["records"], then["duplicated"], then["distinct"])]


class _Session:
    """A purchase commits, an error aborts, a sign-up raises the epoch, so that the commit after it is fenced off."""

    def __init__(self):
        self.session, self.mine = d.TransactionalSession(), 0

    def step(self, seq, kind, v):
        s = self.session
        if kind == "signup":
            s.fence(s.epoch + 1)
            return ()
        if s.open is None:
            s.begin()
        if kind == "purchase":
            if not s.commit(seq, self.mine):
                self.mine = s.epoch
        elif kind == "error":
            s.abort()
        else:
            s.stage(v)
        return ()

    def finish(self):
        s = self.session
        return [(len(s.output), sum(s.output), s.offset, s.aborted, s.fenced, len(s.open or []))]


class _Caches:
    """A purchase flushes, an error crashes, all else writes."""

    def __init__(self):
        self.through, self.back = d.WriteThroughCache(), d.WriteBackCache()

    def step(self, kind, v):
        if kind == "purchase":
            self.back.flush()
        elif kind == "error":
            self.back.crash()
        else:
            self.through.write(v % 6, v)
            self.back.write(v % 6, v)
        return ()

    def finish(self):
        return [(self.through.store_writes(), self.back.store_writes(), self.back.lost, len(self.back.dirty))]


def _query(make, inputs, schema):
    return lambda spark, sf_dir: run_by_key(frame(spark, sf_dir, "ev"), ["k"], ["seq"], inputs, make, schema)


QUERIES = {
    "epochs": _query(_Epochs, ["seq", "kind", "v"], "published long, total long, pending long, dropped long, replays long, epochs long"),
    "exactlyoncefile": _query(_Files, ["kind", "v"], "published long, names long, orphans long, refused long, staged long"),
    "offsets": _query(_Drill, ["kind"], "tape long, commit_first long, lost long, process_first long, duplicated long, deduplicated long"),
    "transactions": _query(_Session, ["seq", "kind", "v"], "committed long, total long, commit_offset long, aborted long, fenced long, pending long"),
    "writecache": _query(_Caches, ["kind", "v"], "write_through long, write_back long, lost long, dirty long"),
}
# The fate of a written row is the next control row of its user.
_FATES = f"""WITH ev AS ({DUCK_EVENTS}),
f AS (SELECT *, first_value(CASE WHEN kind IN {{controls}} THEN kind END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fate,
      first_value(CASE WHEN kind IN {{controls}} THEN seq END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fate_seq FROM ev),
w AS (SELECT * FROM f WHERE kind IN ('view', 'click')), u AS (SELECT DISTINCT k FROM ev) """
_ENDS = _FATES.format(controls="('purchase', 'error')")
_BY_NAME = "(SELECT k, fate, fate_seq, count(DISTINCT v % {m}) AS n FROM w GROUP BY 1, 2, 3)"


def _sum(what, where):
    return f"CAST(coalesce(sum({what}) FILTER ({where}), 0) AS BIGINT)"


ORACLES = {
    "epochs": _ENDS
    + f"""SELECT u.k, {_sum('1', "w.fate = 'purchase'")} AS published, {_sum('w.v', "w.fate = 'purchase'")} AS total, {_sum('1', 'w.k IS NOT NULL AND w.fate IS NULL')} AS pending, {_sum('1', "w.fate = 'error'")} AS dropped,
          any_value(c.replays) AS replays, any_value(c.epochs) AS epochs FROM u LEFT JOIN w ON w.k = u.k
          JOIN (SELECT k, count(*) FILTER (kind = 'purchase') AS epochs, count(*) FILTER (kind = 'signup' AND before > 0) AS replays FROM (SELECT k, kind, count(*) FILTER (kind = 'purchase') OVER (PARTITION BY k ORDER BY seq) AS before FROM ev) x GROUP BY k) c ON c.k = u.k GROUP BY u.k""",
    "exactlyoncefile": _ENDS
    + f"""SELECT u.k, {_sum('x.n', "x.fate = 'purchase'")} AS published, any_value(c.names) AS names, {_sum('x.n', "x.fate = 'error'")} AS orphans, any_value(c.refused) AS refused, {_sum('x.n', 'x.fate IS NULL')} AS staged
          FROM u LEFT JOIN {_BY_NAME.format(m=4)} x ON x.k = u.k JOIN (SELECT k, count(DISTINCT v % 4) FILTER (kind IN ('view', 'click') AND fate = 'purchase') AS names, count(*) FILTER (kind = 'signup') AS refused FROM f GROUP BY k) c ON c.k = u.k GROUP BY u.k""",
    "offsets": f"WITH ev AS ({DUCK_EVENTS}) SELECT k, count(*) AS tape, count(*) FILTER (kind <> 'error') AS commit_first, count(*) FILTER (kind = 'error') AS lost, count(*) + count(*) FILTER (kind = 'error') AS process_first, count(*) FILTER (kind = 'error') AS duplicated, count(*) AS deduplicated FROM ev GROUP BY k",
    # A commit is fenced if a sign-up came after the last commit before it (fenced or not).
    "transactions": _ENDS
    + f""", c AS (SELECT k, seq, count(*) FILTER (kind = 'signup') OVER (PARTITION BY k ORDER BY seq) AS risen, kind FROM ev),
          p AS (SELECT k, seq, risen > coalesce(lag(risen) OVER (PARTITION BY k ORDER BY seq), 0) AS fenced FROM c WHERE kind = 'purchase')
          SELECT u.k, {_sum('1', 'NOT p.fenced')} AS committed, {_sum('w.v', 'NOT p.fenced')} AS total, coalesce(any_value(o.last), -1) AS commit_offset, {_sum('1', "w.fate = 'error'")} AS aborted, {_sum('1', 'p.fenced')} AS fenced, {_sum('1', 'w.k IS NOT NULL AND w.fate IS NULL')} AS pending
          FROM u LEFT JOIN w ON w.k = u.k LEFT JOIN p ON p.k = w.k AND p.seq = w.fate_seq AND w.fate = 'purchase' LEFT JOIN (SELECT k, max(seq) AS last FROM p WHERE NOT fenced GROUP BY k) o ON o.k = u.k GROUP BY u.k""",
    "writecache": _FATES.replace("w AS (SELECT * FROM f WHERE kind IN ('view', 'click'))", "w AS (SELECT * FROM f WHERE kind NOT IN ('purchase', 'error'))").format(controls="('purchase', 'error')")
    + f"""SELECT u.k, any_value(c.n) AS write_through, {_sum('x.n', "x.fate = 'purchase'")} AS write_back, {_sum('x.n', "x.fate = 'error'")} AS lost, {_sum('x.n', 'x.fate IS NULL')} AS dirty
          FROM u LEFT JOIN {_BY_NAME.format(m=6)} x ON x.k = u.k JOIN (SELECT k, count(*) FILTER (kind NOT IN ('purchase', 'error')) AS n FROM ev GROUP BY k) c ON c.k = u.k GROUP BY u.k""",
}
