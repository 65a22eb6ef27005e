"""Lock and blocking analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import label
from tidemark.operators import graphs
from tidemark.operators.ordered import Running, running
from tidemark.session import materialize

#: Waiters and holders of one unit of work of ``conflict_pairs``.
PAIR_TILE = 1000


def one_per_session(sessions: DataFrame, scope: list[str], session: str) -> DataFrame:
    """One row per session id within its scope: of repeated ids the row with the largest values stays."""
    rest = [c for c in sessions.columns if c not in (*scope, session)]
    kept = sessions.groupBy(*scope, session).agg(F.max(F.struct(*rest)).alias("_r")) if rest else sessions.distinct()
    return kept.select(*scope, session, *[F.col("_r")[c].alias(c) for c in rest])


def blocking_pairs(
    sessions: DataFrame, session: str = "session_id", blocker: str = "blocker_id", scope: list[str] | None = None
) -> DataFrame:
    """Waiter joined to its blocker within ``scope`` (such as host and snapshot), each side's other columns prefixed."""
    scope = scope or []
    sessions = one_per_session(sessions, scope, session)
    sides = [c for c in sessions.columns if c not in (*scope, blocker)]
    waiting = sessions.where(F.col(blocker).isNotNull()).select(
        *scope, *[F.col(c).alias(f"blocked_{c}") for c in sides], F.col(blocker).alias(f"blocker_{session}")
    )
    holders = sessions.select(*scope, *[F.col(c).alias(f"blocker_{c}") for c in sides])
    return waiting.join(holders, [*scope, f"blocker_{session}"])


def blocking_pairs_of_arrays(sessions: DataFrame, session: str, blockers: str, scope: list[str] | None = None) -> DataFrame:
    """The same where each waiter lists its blockers: explode, then an equi-join."""
    scope = scope or []
    sessions = one_per_session(sessions, scope, session)
    waiting = sessions.where(F.size(blockers) > 0).select(
        *scope, F.col(session).alias("blocked_id"), F.explode(F.array_distinct(blockers)).alias("blocker_id")
    )
    rest = [c for c in sessions.columns if c not in (*scope, session, blockers)]
    return waiting.join(sessions.select(*scope, F.col(session).alias("blocker_id"), *rest), [*scope, "blocker_id"])


def head_blockers(
    sessions: DataFrame, session: str = "session_id", blocker: str = "blocker_id", scope: list[str] | None = None
) -> DataFrame:
    """Head of the chain and depth for every session within its ``scope``, by pointer doubling.

    Each round doubles the distance covered, so a chain of length n takes about
    log2(n) joins. Sessions that have reached a head leave the loop. Sessions
    still in the loop after the last round wait on a cycle. An id repeated within
    its scope counts once, with its largest blocker.
    """
    scope = scope or []
    sessions = sessions.groupBy(*scope, session).agg(F.max(blocker).alias(blocker))
    links = sessions.where(F.col(blocker).isNotNull()).select(
        *scope, F.col(session).alias("id"), F.col(blocker).alias("ptr"), F.lit(1).cast("bigint").alias("depth")
    )
    heads = sessions.where(F.col(blocker).isNull()).select(
        *scope, F.col(session).alias("id"), F.col(session).alias("ptr"), F.lit(0).cast("bigint").alias("depth")
    )
    # A session whose blocker waits itself is still open. A blocker that is not
    # among the sessions ends a chain like a head does.
    waits_too = links.select(*scope, F.col("id").alias("ptr"), F.lit(True).alias("_more"))

    def step_to(pointers: DataFrame) -> DataFrame:
        marked = pointers.join(waits_too, [*scope, "ptr"], "left")
        return materialize(marked.select(*scope, "id", "ptr", "depth", F.coalesce("_more", F.lit(False)).alias("open")))

    reached = step_to(links)
    settled = heads.unionByName(reached.where(~F.col("open")).drop("open"))
    moving = reached.where("open").drop("open")
    jump = reached.drop("open")
    left = moving.count()
    while left:
        # jump: id -> where it points after 2^round steps; ends stay put.
        leap = jump.select(*scope, F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("depth").alias("more"))
        reached = step_to(_leap(moving, leap, scope))
        settled = settled.unionByName(reached.where(~F.col("open")).drop("open"))
        moving = reached.where("open").drop("open")
        before, left = left, moving.count()
        # As long as a chain is open, each round closes part of it; no progress means only cycles are left.
        if left == before:
            break
        if left:
            jump = materialize(_leap(jump, leap, scope))
    cyclic = moving.select(
        *scope, F.col("id").alias(session), F.lit(None).cast("bigint").alias("head_blocker"), F.lit(None).cast("bigint").alias("depth")
    )
    chains = settled.select(*scope, F.col("id").alias(session), F.col("ptr").cast("bigint").alias("head_blocker"), "depth")
    return chains.withColumn("in_cycle", F.lit(False)).unionByName(cyclic.withColumn("in_cycle", F.lit(True)))


def _leap(pointers: DataFrame, step: DataFrame, scope: list[str]) -> DataFrame:
    return pointers.join(step, [*scope, "ptr"], "left").select(
        *scope,
        "id",
        F.coalesce("to", "ptr").alias("ptr"),
        (F.col("depth") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("depth"),
    )


def chains_by_head(chains: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Blocked sessions and longest chain per head within its scope."""
    return (
        chains.where((F.col("depth") > 0) & ~F.col("in_cycle"))
        .groupBy(*(scope or []), "head_blocker")
        .agg(F.count("*").alias("blocked_sessions"), F.max("depth").alias("chain_depth"))
    )


def _wait_edges(sessions: DataFrame, session: str, blockers: str, scope: list[str]) -> DataFrame:
    """Distinct rows (scope, session, _blocker) of what the sessions list as blockers."""
    listed = sessions.where(F.col(session).isNotNull()).select(*scope, session, F.explode(blockers).alias("_blocker"))
    return listed.where("_blocker IS NOT NULL").distinct()


def _node(scope: list[str], name: str):
    return F.struct(*scope, F.col(name).cast("bigint").alias("id"))


def head_sets(
    sessions: DataFrame, session: str = "session_id", blockers: str = "blockers", scope: list[str] | None = None
) -> DataFrame:
    """Rows (scope, waiter, head): every head that a waiting session waits for in the end, through any of its blockers.

    A head waits for nobody, or is not among the sessions. Ways through sessions
    with one blocker are shortened first by pointer doubling; then heads spread against the
    edges of the sessions with several blockers, round by round. Cycles end by
    themselves; a session that waits for cycles only has no head. The rows of a repeated id add up.
    """
    scope = scope or []
    listed = _wait_edges(sessions, session, blockers, scope)
    edges = materialize(listed.select(_node(scope, session).alias("src"), _node(scope, "_blocker").alias("dst")), "wait_edges")
    degrees = materialize(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("dst").alias("next")), "degrees")
    single, forks = degrees.where("n = 1").select("node", "next"), degrees.where("n > 1").select("node")
    ends = materialize(graphs.chain_ends(single), "ends")
    # A fork's blockers, each replaced by the end of its chain; chains that run into a cycle lead to no head.
    looped = single.select(F.col("node").alias("dst")).join(ends.withColumnRenamed("node", "dst"), "dst", "left_anti")
    ways = edges.join(forks.withColumnRenamed("node", "src"), "src", "left_semi").join(looped, "dst", "left_anti")
    ways = ways.join(ends.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"))
    ways = materialize(ways.distinct(), "ways")
    heads = ends.select(F.col("end").alias("node")).union(ways.select("dst")).distinct().join(forks, "node", "left_anti")
    reached = graphs.spread(ways, heads.withColumn("label", F.col("node"))).select(F.col("node").alias("end"), "label")
    found = ends.unionByName(forks.withColumn("end", F.col("node"))).join(reached, "end")
    return found.select(*[F.col("node")[c].alias(c) for c in scope], F.col("node.id").alias("waiter"), F.col("label.id").alias("head"))


def blocking_cycles(
    sessions: DataFrame, session: str = "session_id", blockers: str = "blockers", scope: list[str] | None = None
) -> DataFrame:
    """Rows (scope, cycle, session) of the sessions that wait for each other; ``cycle`` is the smallest of them."""
    scope = scope or []
    edges = _wait_edges(sessions, session, blockers, scope)
    found = graphs.components_of_cycles(edges.select(_node(scope, session).alias("src"), _node(scope, "_blocker").alias("dst")))
    return found.select(*[F.col("node")[c].alias(c) for c in scope], F.col("component.id").alias("cycle"), F.col("node.id").alias(session))


def lock_conflicts(locks: DataFrame, resource: list[str], pid: str, granted: str, ts: str) -> DataFrame:
    """One row per waiting request with what holds its resource.

    The pairs (waiter, holder) are kept in factored form: holders are reduced
    per resource and joined once to the waiters, so a resource wanted by a third
    of all requests yields one row per request instead of all pairs. Resources
    compare null-safely. A session's own locks do not block it.
    """
    named = [F.col(c).alias(f"_r_{c}") for c in resource]
    holding = materialize(locks.where(F.col(granted)).groupBy(*resource, pid).agg(F.min(ts).alias("_since")))
    first_two = F.array_sort(F.array_compact(F.array("_f", "_g")))
    per_resource = holding.groupBy(*named).agg(
        F.count("*").alias("_holders"), F.min(F.struct("_since", F.col(pid).alias("p"))).alias("_f")
    )
    resource_join = F.lit(True)
    for c in resource:
        resource_join = resource_join & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    second = (
        holding.join(per_resource, resource_join)
        .where(F.col(pid) != F.col("_f.p"))
        .groupBy(*[F.col(c).alias(f"_q_{c}") for c in resource])
        .agg(F.min(F.struct("_since", F.col(pid).alias("p"))).alias("_g"))
    )
    second_join = F.lit(True)
    for c in resource:
        second_join = second_join & F.col(f"_r_{c}").eqNullSafe(F.col(f"_q_{c}"))
    holders = per_resource.join(second, second_join, "left").withColumn("_oldest", first_two)
    own = holding.select(*[F.col(c).alias(f"_o_{c}") for c in resource], F.col(pid).alias("_o_pid"))
    own_join = F.col(pid) == F.col("_o_pid")
    for c in resource:
        own_join = own_join & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    waiting = locks.where(~F.col(granted)).join(own, own_join, "left").join(holders, resource_join)
    others = F.filter("_oldest", lambda h: h["p"] != F.col(pid))
    count = F.col("_holders") - F.when(F.col("_o_pid").isNotNull(), 1).otherwise(0)
    return waiting.select(
        *locks.columns, count.alias("blocking_holders"), F.get(others, F.lit(0))["p"].alias("oldest_holder")
    ).where(F.col("blocking_holders") > 0)


def _lock_sides(locks: DataFrame, resource: list[str], pid: str, granted: str) -> DataFrame:
    """One row per resource and session: whether it waits, whether it holds (0 or 1)."""
    held = F.coalesce(F.col(granted), F.lit(False))
    return locks.where(F.col(pid).isNotNull()).groupBy(*resource, pid).agg(
        F.max((~held).cast("bigint")).alias("_waits"), F.max(held.cast("bigint")).alias("_holds")
    )


def _null_safe(columns: list[str], prefix: str):
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return condition


def conflict_counts(locks: DataFrame, resource: list[str], pid: str, granted: str) -> DataFrame:
    """Number of (waiter, holder, resource) pairs in which each session waits, and in which it holds.

    Pairs stay factored: a resource's waiters and holders are counted, and every
    session takes the other side's number less the pair that it would make with itself.
    """
    sides = materialize(_lock_sides(locks, resource, pid, granted), "lock_sides")
    sizes = sides.groupBy(*[F.col(c).alias(f"_r_{c}") for c in resource]).agg(F.sum("_waits").alias("_w"), F.sum("_holds").alias("_h"))
    both = F.col("_waits") * F.col("_holds")
    pairs = sides.join(sizes, _null_safe(resource, "_r_"))
    return pairs.groupBy(pid).agg(
        F.sum(F.col("_waits") * F.col("_h") - both).alias("pairs_waiting"), F.sum(F.col("_holds") * F.col("_w") - both).alias("pairs_holding")
    )


def conflict_pairs(
    locks: DataFrame, resource: list[str], pid: str, granted: str, blocked: str = "true", tile: int = PAIR_TILE, **options
) -> DataFrame:
    """Explicit (waiter, holder) pairs per resource, for the waiting sessions that meet the SQL condition ``blocked``.

    Waiters and holders of a resource are numbered, which numbers its pairs: waiter i
    and holder j make pair ``i * holders + j``. The pairs are cut into tiles of ``tile``
    waiters by ``tile`` holders, and each tile is a join key of its own. So a resource that
    a third of all requests want is as many even units of work as it has tiles, and a
    row is copied once per tile that it is in. ``options`` go to ``ordered.running``.
    """
    sides = materialize(_lock_sides(locks, resource, pid, granted), "lock_sides")

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        ranked = running(rows, resource, [pid], {"_rank": Running("count", F.lit(1), inclusive=False)}, **options)
        return materialize(ranked.select(*resource, pid, F.floor(F.col("_rank") / tile).cast("int").alias(name)), "numbered")

    waiters = numbered(sides.where("_waits = 1").where(blocked).drop("_waits", "_holds"), "_i")
    holders = numbered(sides.where("_holds = 1").drop("_waits", "_holds"), "_j")

    def copied(rows: DataFrame, other: DataFrame, name: str, prefix: str) -> DataFrame:
        tiles = other.groupBy(*[F.col(c).alias(f"_n_{c}") for c in resource]).agg(F.max(name).alias("_last"))
        met = rows.join(tiles, _null_safe(resource, "_n_")).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_last"))))
        return met.select(*[F.col(c).alias(f"{prefix}{c}") for c in resource], F.col(pid).alias(f"{prefix}pid"), F.col("_i").alias(f"{prefix}i"), F.col("_j").alias(f"{prefix}j"))

    left, right = copied(waiters, holders, "_j", "_w_"), copied(holders, waiters, "_i", "_h_")
    same = (F.col("_w_i") == F.col("_h_i")) & (F.col("_w_j") == F.col("_h_j"))
    for c in resource:
        same = same & F.col(f"_w_{c}").eqNullSafe(F.col(f"_h_{c}"))
    return left.join(right, same).where("_w_pid <> _h_pid").select(
        F.col("_w_pid").alias("blocked_pid"), F.col("_h_pid").alias("holder_pid"), *[F.col(f"_w_{c}").alias(c) for c in resource]
    )


def in_contention(locks: DataFrame, resource: list[str], pid: str, granted: str) -> DataFrame:
    """Sessions that hold or await a contended resource: two aggregates instead of a self-join with OR."""
    contended = (
        locks.groupBy(*resource)
        .agg(F.count_if(F.col(granted)).alias("_h"), F.count_if(~F.col(granted)).alias("_w"))
        .where((F.col("_h") > 0) & (F.col("_w") > 0))
        .select(*[F.col(c).alias(f"_r_{c}") for c in resource])
    )
    condition = F.lit(True)
    for c in resource:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return locks.select(*resource, pid).join(contended, condition, "left_semi").select(pid).distinct()


def lock_inventory(locks: DataFrame, by: list[str], granted: str) -> DataFrame:
    return locks.groupBy(*by).agg(
        F.count_if(F.col(granted)).alias("granted"), F.count_if(~F.col(granted)).alias("waiting")
    )


def blocked_scope(blocked: DataFrame, by: list[str]) -> DataFrame:
    """Number of blocked sessions and the decision it leads to."""
    counted = blocked.groupBy(*by).agg(F.count("*").alias("blocked_sessions"))
    n = F.col("blocked_sessions")
    return counted.withColumn(
        "decision",
        label(n, [(n >= 10, "KILL_BLOCKER_AND_RETRY"), (n > 2, "ESCALATE"), (n >= 1, "INVESTIGATE_BLOCKER")], "NONE"),
    )
