"""Deciding ordered requests that compete for accounts.

A request carries postings. Each posting belongs to an account and takes effect
at a position of the total order. A guarded posting needs at least ``need`` on
its account beforehand. A request is accepted when all of its guards hold given
the accepted requests before it, exactly as if the requests ran one by one.

The decisions are found in rounds over all undecided requests at once. Running
sums give the lowest and highest amount an account can have at each posting,
over all ways the undecided requests before it may end. A request whose guards
hold at the lowest amounts is accepted, one with a guard that fails at the
highest is refused. While bounds settle a good share of what is open, they go on alone:
such a round costs two shuffles of the open postings, and the tables shrink from round to round.

Chains of requests that depend on each other decide few per round by bounds. Then, or once one
task can take all that is open, a round also cuts the order into blocks and runs the requests of each block one by one, all
blocks at once, each on the amounts that the guesses of the round before give it. Up to
and with the first block in which a guess changes, all blocks started from amounts that
are exact, so their requests are settled; the others take what was found as new guesses. The
blocks double from round to round, up to ``block_requests`` requests, so the rounds follow
the logarithm of a chain's length up to there, and beyond it the number of such blocks.

When there are more open requests than that, those that share no account, not even over
others, are told apart first, and every such group has blocks and progress of its own; a group
that fits into one block is settled at once, and small groups share tasks.

A guard that holds at the lowest amount holds whatever comes, so it is dropped. On an account without a guard in
doubt amounts no longer matter, and its postings go; an open request has a row without an account that stands for it.
The first round leaves out accounts whose opening amounts cover all that can ever be taken, by their totals alone.

A round's postings are removed once the next one is stored.

Columns of a posting:
    seq       position of its request in the order; unique, dense, null for opening amounts
    account, a, b   the account; none of them is null in a guarded posting
    at_seq    position at which the amount takes effect, seq or later
    coef      amount added per accepted unit
    cap       largest number of units, 1 except for requests that take what is there
    need      amount the account must hold beforehand, null without a guard
    lead      true for one posting of each request; in the rounds, for the row that stands for it
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.plans.components import components
from tradeloom.plans.prefix import BUCKETS, hot_buckets, running_before
from tradeloom.plans.workspace import dropped, stored

# The numbers come first: a sort compares by its first column, and there are but a few sorts of accounts.
ACCOUNT = ["a", "b", "account"]
COLUMNS = ["seq", *ACCOUNT, "at_seq", "coef", "cap", "need", "lead"]
OPEN, ACCEPTED, REFUSED = 0, 1, 2

BLOCK_ROWS = 1_000_000
BLOCK_REQUESTS = 1 << 17
FIRST_BLOCK = 1 << 12
# Bounds go on alone while they leave no more than this share of the requests open.
SHRUNK = 0.7

# What a round carries beside the posting itself.
CARRIED = ["flock", "guess", "base"]
AMOUNTS = ["sure", "down", "up", "likely"]
# The row of a request that has no account.
STANDS = "lead AND account IS NULL"


# The amounts of a packed row, which are made after the shuffle.
UNPACKED = [
    "IF(seq IS NULL, coef, 0) AS sure",
    "IF(seq IS NULL, cap, least(coef * cap, 0)) AS down",
    "IF(seq IS NULL, need, greatest(coef * cap, 0)) AS up",
    "IF(seq IS NULL, guess, coef * guess) AS likely",
]


def _packed_rows(current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that make up the amounts, open rows that look at none), in as few columns as say it all.

    Open postings are as they are. What is settled has no ``seq``; its ``coef``, ``cap``, ``need`` and
    ``guess`` are the amounts ``sure``, ``down``, ``up`` and ``likely`` that it adds.
    """
    parts = current.filter(f"NOT ({STANDS}) AND (state = {OPEN} OR state = {ACCEPTED} AND live)")
    deferred = parts.filter("at_seq > seq")
    kept = [*ACCOUNT, "at_seq", *CARRIED, "lead"]
    own = parts.filter("seq IS NULL OR at_seq = seq").selectExpr(
        *[c for c in kept if c != "guess"],
        f"IF(state = {OPEN}, seq, NULL) AS seq",
        f"IF(state = {OPEN}, coef, coef * units) AS coef",
        f"IF(state = {OPEN}, cap, 0) AS cap",
        f"IF(state = {OPEN}, need, 0) AS need",
        f"IF(state = {OPEN}, guess, 0) AS guess",
    )
    # Postings deferred to one position may be many; only their sums matter to others.
    lumped = deferred.groupBy(*ACCOUNT, "at_seq").agg(
        F.expr(f"sum(IF(state = {ACCEPTED}, coef * units, 0)) AS coef"),
        F.expr(f"sum(IF(state = {OPEN}, least(coef * cap, 0), 0)) AS cap"),
        F.expr(f"sum(IF(state = {OPEN}, greatest(coef * cap, 0), 0)) AS need"),
        F.expr(f"sum(IF(state = {OPEN}, coef * guess, 0)) AS guess"),
    )
    return own.unionByName(lumped, allowMissingColumns=True), current.filter(f"state = {OPEN} AND ({STANDS} OR at_seq > seq)")


# The least amount an account can have, and the most that a guard on it asks for beside what its own posting takes.
FLOOR = "sum(IF(seq IS NOT NULL, least(coef * cap, 0), cap + IF(at_seq > 0, least(coef, 0), coef)))"
CLAIM = "max(IF(seq IS NOT NULL, IF(cap > 1, cap, need) + least(coef * cap, 0), NULL))"


def _contested(rows: DataFrame) -> DataFrame:
    """Packed rows of the first round, of the accounts whose totals leave a guard in doubt, placed by account.

    Where opening amounts cover all that can ever be taken, every guard holds whatever the order. Nothing is settled
    in the first round, so all further columns follow from those compared here, and both sides read one shuffle.
    """
    named = rows.filter(" AND ".join(f"{key} IS NOT NULL" for key in ACCOUNT))
    placed = named.select("seq", *ACCOUNT, "at_seq", "coef", "cap", "need").repartition(*ACCOUNT)
    totals = placed.groupBy(*ACCOUNT).agg(F.expr(FLOOR).alias("floor"), F.expr(CLAIM).alias("claim"))
    doubted = totals.filter("floor < claim").select(*ACCOUNT).hint("shuffle_hash")
    return placed.join(doubted, ACCOUNT).selectExpr(
        "*", "0L AS flock", "IF(seq IS NULL, cap + need, cap) AS guess", "0L AS base", "false AS lead"
    )


def _bounded(postings: DataFrame, block_rows: int, hot: list[int], first: bool = False) -> DataFrame:
    """Open postings with their settled base, the bounds of their account and its amount under the guesses."""
    rows, waiting = _packed_rows(postings)
    inside = F.expr(f"pmod(hash({', '.join(ACCOUNT)}), {BUCKETS})").isin(hot)
    apart = rows.filter(~inside) if hot else rows
    placed = (_contested(apart) if first else apart.repartition(*ACCOUNT)).selectExpr("*", *UNPACKED)
    cool = _ranges(running_before(placed, ACCOUNT, "at_seq", AMOUNTS, block_rows, []))
    bounded = cool.withColumn("live", F.expr(f"max({IN_DOUBT}) OVER (PARTITION BY {', '.join(ACCOUNT)})"))
    if hot:
        blocks = rows.filter(inside).selectExpr("*", *UNPACKED)
        warm = _ranges(running_before(blocks, ACCOUNT, "at_seq", AMOUNTS, block_rows, hot))
        bounded = bounded.unionByName(warm.withColumn("live", F.lit(True)))
    others = waiting.select(*COLUMNS, *CARRIED).withColumn("live", F.lit(True))
    return bounded.filter("lead OR live OR need IS NOT NULL").unionByName(others, allowMissingColumns=True)


IN_DOUBT = "need IS NOT NULL AND high >= need"


def _ranges(summed: DataFrame) -> DataFrame:
    """Open postings with the range of the amount they find, without the guards that hold anywhere in it."""
    ranges = summed.filter("seq IS NOT NULL").selectExpr(
        *COLUMNS,
        "flock",
        "guess",
        "base + before_sure AS base",
        "base + before_sure + before_likely AS likely",
        "base + before_sure + before_down AS low",
        "base + before_sure + before_up AS high",
    )
    return ranges.withColumn("need", F.expr("IF(low >= IF(cap > 1, cap, need), NULL, need)"))


def _decided(bounded: DataFrame) -> DataFrame:
    """Postings with the state that the bounds allow for their request.

    A request with several units takes what its account holds: it is settled
    when all units are certain to be there, or when the amount is exact.
    """
    checks = bounded.selectExpr(
        "*",
        "need IS NULL OR (cap > 1 AND low = high AND low >= need) AS holds",
        "need IS NOT NULL AND high < need AS fails",
        "IF(need IS NOT NULL AND cap > 1, least(low, cap), cap) AS most",
    )
    verdict = checks.selectExpr(
        *COLUMNS,
        *CARRIED,
        "live",
        "likely",
        "min(holds) OVER (PARTITION BY seq) AS holds",
        "max(fails) OVER (PARTITION BY seq) AS fails",
        "min(most) OVER (PARTITION BY seq) AS most",
    )
    return verdict.selectExpr(
        *COLUMNS,
        *CARRIED,
        "live",
        "likely",
        f"CASE WHEN holds THEN {ACCEPTED} WHEN fails THEN {REFUSED} ELSE {OPEN} END AS state",
        "IF(holds, most, 0) AS units",
    )


# A request whose outcome may differ from its guess; the others change nothing for those after them.
DOUBTFUL = f"(state = {OPEN} OR units <> guess)"


def _run(table: pa.Table) -> pa.Table:
    """The doubtful requests of one block, one by one: (flock, block, seq, found), one row per request.

    The amount at a posting is the likely one, corrected by how the requests of the block
    before it ended against their guesses.
    """
    columns = table.select(["seq", "account", "a", "b", "at_seq", "coef", "cap", "need", "guess", "likely", "state", "units"])
    requests: dict[int, list[tuple]] = defaultdict(list)
    for row in zip(*(column.to_pylist() for column in columns.columns), strict=True):
        requests[row[0]].append(row)
    change: dict[tuple, int] = defaultdict(int)
    later: list[tuple] = []
    seqs, found = sorted(requests), []
    for seq in seqs:
        while later and later[0][0] < seq:
            _, account, amount = heapq.heappop(later)
            change[account] += amount
        postings = requests[seq]
        if postings[0][10] == OPEN:
            ended = None
            for _, account, a, b, _, _, cap, need, _, likely, _, _ in postings:
                most = cap
                if need is not None:
                    amount = likely + change.get((account, a, b), 0)
                    most = 0 if amount < need else min(amount, cap) if cap > 1 else cap
                ended = most if ended is None else min(ended, most)
        else:
            ended = postings[0][11]
        found.append(ended)
        for _, account, a, b, at_seq, coef, _, _, guess, _, _, _ in postings:
            amount = coef * (ended - guess)
            if not amount:
                continue
            if at_seq > seq:
                heapq.heappush(later, (at_seq, (account, a, b), amount))
            else:
                change[account, a, b] += amount
    count = len(seqs)
    return pa.table(
        {
            "flock": pa.array([table["flock"][0].as_py()] * count, pa.int64()),
            "block": pa.array([table["block"][0].as_py()] * count, pa.int64()),
            "seq": pa.array(seqs, pa.int64()),
            "found": pa.array(found, pa.int64()),
        }
    )


def _outcomes(runs: DataFrame, doubts: int, block_requests: int) -> DataFrame:
    """What ``_run`` finds in all blocks, in tasks by the number of requests: their few bytes say little of the work."""
    spread = runs.repartition(8 * doubts // block_requests + 1, "flock", "block")
    return spread.groupBy("flock", "block").applyInArrow(_run, "flock bigint, block bigint, seq bigint, found bigint")


def _flocks(decided: DataFrame) -> DataFrame:
    """(seq, own): a number for each set of doubtful requests that share accounts, directly or over others."""
    ends = decided.filter(f"NOT ({STANDS}) AND {DOUBTFUL}").selectExpr("seq AS a", "-1 - (xxhash64(account, a, b) & 4611686018427387903) AS b")
    return components(ends).filter("node >= 0").selectExpr("node AS seq", "component AS own")


def _packed(flocks: DataFrame, doubts: int, block_requests: int) -> DataFrame:
    """(seq, own) with small flocks put together, several to a block; flocks share nothing, so their union is one."""
    sizes = flocks.groupBy("own").agg(F.count(F.lit(1)).alias("size"))
    parts = 4 * doubts // block_requests + 1
    return flocks.join(sizes, "own").selectExpr(
        "seq", f"IF(size * 16 <= {block_requests}, -1 - pmod(xxhash64(own), {parts}), own) AS own"
    )


def _largest(sized: DataFrame, width: int, block_requests: int) -> int:
    """Requests in the largest block of that width, of flocks that need several."""
    cut = sized.filter(f"lead AND size > {block_requests}")
    return cut.groupBy("flock", F.expr(f"seq div {width}")).count().agg(F.max("count")).first()[0] or 0


def _leads(postings: DataFrame) -> DataFrame:
    """A row for each request that stands for it alone, without an account."""
    types = dict(postings.dtypes)
    fixed = {"at_seq": "seq", "coef": "0", "cap": "cap", "lead": "lead", "seq": "seq"}
    columns = [f"CAST({fixed.get(name, 'NULL')} AS {types[name]}) AS {name}" for name in COLUMNS]
    return postings.filter("lead").selectExpr(*columns)


def settle(
    postings: DataFrame,
    block_rows: int = BLOCK_ROWS,
    block_requests: int = BLOCK_REQUESTS,
    first_block: int = FIRST_BLOCK,
    hot: list[int] | None = None,
) -> tuple[DataFrame, int]:
    """((seq, units) of every request, rounds). ``units`` is 0 for a refused request.

    Postings with a null seq are opening amounts and always count. ``hot`` names the buckets of accounts with more
    than ``block_rows`` postings, found here when it is not given. The driver sees a few counts per round.
    """
    current = postings.select(*COLUMNS).withColumn("lead", F.lit(False)).unionByName(_leads(postings)).selectExpr(
        *COLUMNS,
        "CAST(0 AS BIGINT) AS flock",
        "cap AS guess",
        "CAST(0 AS BIGINT) AS base",
        "true AS live",
        f"IF(seq IS NULL, {ACCEPTED}, {OPEN}) AS state",
        "IF(seq IS NULL, cap, 0) AS units",
    )
    verdicts: list[DataFrame] = []
    if hot is None:
        hot = hot_buckets(postings, ACCOUNT, block_rows)
    rounds, width, flocked, before = 0, first_block, False, []
    while True:
        rounds += 1
        decided = stored(_decided(_bounded(current, block_rows, hot, rounds == 1)), "round")
        asked, open_now, doubts = (
            decided.filter("lead").selectExpr("count(*)", f"count_if(state = {OPEN})", f"count_if({DOUBTFUL})").first()
        )
        if not open_now:
            verdicts.append(stored(decided.filter("lead").select("seq", "units"), "verdicts"))
            dropped(decided, *before)
            break
        if doubts > block_requests and open_now <= SHRUNK * asked:
            verdicts.append(stored(decided.filter(f"lead AND state <> {OPEN}").select("seq", "units"), "verdicts"))
            dropped(*before)
            current, before = decided.drop("likely"), [decided]
            continue
        if doubts > block_requests and not flocked:
            flocks = _packed(_flocks(decided), doubts, block_requests)
            split = decided.drop("flock").join(flocks, "seq", "left")
            decided, before = (
                stored(split.withColumn("flock", F.coalesce("own", F.lit(0))).select(*decided.columns), "round"),
                [*before, decided],
            )
            flocked = True
        doubtful = decided.filter(DOUBTFUL)
        sized = doubtful.join(doubtful.filter("lead").groupBy("flock").agg(F.count(F.lit(1)).alias("size")), "flock")
        if rounds > 1 and doubts > block_requests and _largest(sized, 2 * width, block_requests) <= block_requests:
            width *= 2
        runs = sized.withColumn("block", F.expr(f"IF(size <= {block_requests}, 0, seq div {width})"))
        outcomes = stored(_outcomes(runs, doubts, block_requests), "outcomes")
        # Up to the first block of a flock with a changed guess, all outcomes are exact.
        guesses = decided.filter("lead").select("seq", "guess")
        changed = outcomes.join(guesses, "seq").filter("found <> guess").groupBy("flock").agg(F.min("block").alias("first"))
        known = outcomes.join(changed, "flock", "left").selectExpr("seq", "found", "first IS NULL OR block <= first AS exact")
        exact = f"(state = {OPEN} AND exact)"
        current = stored(
            decided.join(known, "seq", "left").selectExpr(
                *COLUMNS,
                "flock",
                "coalesce(found, guess) AS guess",
                "base",
                "live",
                f"CASE WHEN NOT {exact} THEN state WHEN found > 0 THEN {ACCEPTED} ELSE {REFUSED} END AS state",
                f"IF({exact}, found, units) AS units",
            ),
            "round",
        )
        verdicts.append(stored(current.filter(f"lead AND state <> {OPEN}").select("seq", "units"), "verdicts"))
        dropped(decided, outcomes, *before)
        before = [current]
        if not current.filter(f"state = {OPEN}").limit(1).count():
            dropped(current)
            break
    # Pairwise unions keep the plan shallow after many rounds.
    while len(verdicts) > 1:
        verdicts = [
            a.unionAll(verdicts[i + 1]) if i + 1 < len(verdicts) else a
            for i, a in enumerate(verdicts)
            if i % 2 == 0
        ]
    return verdicts[0], rounds
