"""Replaying ordered purchase, sale, market, admin and game requests.

Each kind of request becomes postings against four sorts of accounts: the cash
of a user, the stock of an item, a holding of a user and item, and the open
quantity of an offer. ``settle`` decides them; the results are new snapshots,
log rows, and a reason for every refused request.

Cancelling returns whatever is left of an offer. That amount is the listed
quantity less the accepted purchases, so it is posted in those parts, each taking
effect at the position of the cancellation. After it the offer is closed whatever
happened before, so later requests for it are refused outright.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.numbers import half_price
from tradeloom.plans.numbering import dense_numbers
from tradeloom.plans.prefix import hot_buckets, running_before
from tradeloom.plans.settlement import ACCOUNT, BLOCK_ROWS, COLUMNS, settle
from tradeloom.plans.workspace import dropped, stored

# Request kinds.
BUY, SELL = "buy", "sell"
LIST, MARKET_BUY, CANCEL = "list", "market_buy", "cancel"
GRANT, STOCK_ADD, STOCK_REMOVE = "grant", "stock_add", "stock_remove"
REWARD = "reward"
KINDS = (BUY, SELL, LIST, MARKET_BUY, CANCEL, GRANT, STOCK_ADD, STOCK_REMOVE, REWARD)

CASH, STOCK, HOLDING, OFFER = "cash", "stock", "holding", "offer"

REQUEST_COLUMNS = {
    "seq": "bigint",
    "kind": "string",
    "user_id": "bigint",
    "item_id": "bigint",
    "offer_id": "bigint",
    "quantity": "bigint",
    "price_per_unit": "bigint",
    "need": "bigint",
    "coins": "bigint",
    "at": "timestamp_ntz",
}


@dataclass
class Replay:
    """Outcome of a replay: one decision per request, new snapshots and new log rows.

    The requests and their units are stored; each table is computed from them when it is read.
    """

    decisions: DataFrame
    users: DataFrame
    items: DataFrame
    inventory: DataFrame
    offers: DataFrame
    transactions: DataFrame
    trades: DataFrame
    participants: DataFrame
    rounds: int


def number_requests(requests: DataFrame, order: list) -> DataFrame:
    """Requests with the dense ``seq`` that ``replay`` needs, in the given order."""
    return dense_numbers(requests, order, "seq")


def _shaped(requests: DataFrame) -> DataFrame:
    """All request columns, null where the caller has none."""
    present = set(requests.columns)
    return requests.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in REQUEST_COLUMNS.items()
        ]
    )


def _directory(requests: DataFrame, offers: DataFrame, first_new: int) -> DataFrame:
    """Every offer that a request can mean: stored ones, and those of the listed ones that a request names."""
    named = requests.filter(F.col("kind").isin(MARKET_BUY, CANCEL) & (F.col("offer_id") >= first_new))
    stored = offers.select(
        F.col("id").alias("offer_id"),
        F.col("seller_id").alias("o_seller"),
        F.col("item_id").alias("o_item"),
        F.col("price_per_unit").alias("o_price"),
        F.when(F.col("status") == "active", F.col("quantity")).otherwise(0).alias("o_open"),
        F.lit(0).cast("bigint").alias("o_seq"),
    )
    listings = requests.filter((F.col("kind") == LIST) & F.col("offer_id").isNotNull())
    listed = listings.join(named.select("offer_id").distinct(), "offer_id", "left_semi").select(
        "offer_id",
        F.col("user_id").alias("o_seller"),
        F.col("item_id").alias("o_item"),
        F.col("price_per_unit").alias("o_price"),
        F.lit(0).cast("bigint").alias("o_open"),
        F.col("seq").alias("o_seq"),
    )
    directory = stored.unionByName(listed)
    cancels = (
        requests.filter(F.col("kind") == CANCEL)
        .select("offer_id", F.col("user_id").alias("c_user"), F.col("seq").alias("c_seq"))
        .join(directory.select("offer_id", "o_seller", "o_seq"), "offer_id")
        .filter((F.col("c_user") == F.col("o_seller")) & (F.col("c_seq") > F.col("o_seq")))
        .groupBy("offer_id")
        .agg(F.min("c_seq").alias("closing_seq"))
    )
    return directory.join(cancels, "offer_id", "left")


def _named(requests: DataFrame, first_new: int) -> DataFrame:
    """Requests whose listings all have an offer id of their own, beyond the stored ids by their position.

    Ids are always assigned, so no listing can take the id of another offer.
    """
    own = F.lit(first_new) + F.col("seq")
    return requests.withColumn("offer_id", F.when(F.col("kind") == LIST, own).otherwise(F.col("offer_id")))


def _enriched(
    named: DataFrame, users: DataFrame, items: DataFrame, directory: DataFrame, listings: DataFrame
) -> DataFrame:
    """Requests with the price, existence and offer facts that never change during a replay."""
    people = users.select(F.col("id").alias("user_id"), F.lit(True).alias("user_known"))
    goods = items.select(
        F.col("id").alias("item_id"), F.col("price").alias("item_price"), F.lit(True).alias("item_known")
    )
    # Most kinds of requests name no offer; they stay out of the join, where they would all be one key.
    listing = F.coalesce(F.col("kind") == LIST, F.lit(False))
    about = named.filter("offer_id IS NOT NULL").filter(~listing).join(directory, "offer_id", "left")
    new = named.filter("offer_id IS NOT NULL").filter(listing).join(listings, "offer_id", "left")
    others = named.filter("offer_id IS NULL")
    facts = (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [about, new, others])
        .join(people, "user_id", "left")
        .join(goods, "item_id", "left")
    )
    return facts.withColumns(
        {
            "user_known": F.coalesce("user_known", F.lit(False)),
            "item_known": F.coalesce("item_known", F.lit(False)),
            "unit": F.when(F.col("kind").isin(BUY), F.col("item_price"))
            .when(F.col("kind") == SELL, half_price("item_price"))
            .when(F.col("kind") == MARKET_BUY, F.col("o_price"))
            .when(F.col("kind") == LIST, F.col("price_per_unit"))
            .otherwise(0),
        }
    ).withColumn("cost", F.col("unit") * F.col("quantity"))


def _static_refusal() -> Column:
    """Reason that needs no account: the request is refused whatever came before."""
    kind, quantity = F.col("kind"), F.coalesce("quantity", F.lit(0))
    counted = kind.isin(BUY, SELL, LIST, MARKET_BUY, GRANT, STOCK_ADD, STOCK_REMOVE)
    on_offer = kind.isin(MARKET_BUY, CANCEL)
    closed = (
        F.col("o_seller").isNull()
        | (F.col("seq") < F.col("o_seq"))
        | (F.col("seq") > F.coalesce("closing_seq", F.lit(2**62)))
        | ((kind == CANCEL) & (F.col("user_id") != F.col("o_seller")))
    )
    about_item = kind.isin(BUY, SELL, LIST, GRANT, STOCK_ADD, STOCK_REMOVE)
    return F.coalesce(
        F.when(~kind.isin(*KINDS) | kind.isNull(), F.lit("unknown_kind")),
        F.when(counted & (quantity <= 0), F.lit("bad_quantity")),
        F.when(about_item & F.col("item_id").isNull(), F.lit("unknown_item")),
        F.when(F.col("user_id").isNull(), F.lit("unknown_user")),
        F.when((kind == LIST) & (F.coalesce("price_per_unit", F.lit(-1)) < 0), F.lit("bad_price")),
        F.when(kind.isin(BUY, GRANT, STOCK_ADD) & ~F.col("item_known"), F.lit("unknown_item")),
        F.when((kind == REWARD) & F.col("item_id").isNotNull() & ~F.col("item_known"), F.lit("unknown_item")),
        F.when(on_offer & closed, F.lit("offer_closed")),
        F.when(kind.isin(GRANT, STOCK_ADD, REWARD) & ~F.col("user_known"), F.lit("unknown_user")),
    )


def _doomed() -> Column:
    """Reason that is refused for certain, but is reported after account checks."""
    kind = F.col("kind")
    return F.coalesce(
        F.when(kind.isin(BUY, MARKET_BUY) & ~F.col("user_known"), F.lit("unknown_user")),
        F.when((kind == SELL) & ~F.col("item_known"), F.lit("unknown_item")),
        F.when((kind == MARKET_BUY) & (F.col("user_id") == F.col("o_seller")), F.lit("own_offer")),
    )


# Postings of each kind of request: (account, a, b, coef, need, at_seq). The first one leads.
SHARED = {
    BUY: [
        (STOCK, "item_id", "0", "-quantity", "quantity", "seq"),
        (CASH, "user_id", "0", "-cost", "cost", "seq"),
        (HOLDING, "user_id", "item_id", "quantity", "NULL", "seq"),
    ],
    SELL: [
        (HOLDING, "user_id", "item_id", "-quantity", "quantity", "seq"),
        (CASH, "user_id", "0", "cost", "NULL", "seq"),
        (STOCK, "item_id", "0", "quantity", "NULL", "seq"),
    ],
    LIST: [
        (HOLDING, "user_id", "item_id", "-quantity", "quantity", "seq"),
    ],
    MARKET_BUY: [
        (OFFER, "offer_id", "0", "-quantity", "quantity", "seq"),
        (CASH, "user_id", "0", "-cost", "cost", "seq"),
        (CASH, "o_seller", "0", "cost", "NULL", "seq"),
        (HOLDING, "user_id", "o_item", "quantity", "NULL", "seq"),
    ],
    CANCEL: [(OFFER, "offer_id", "0", "0", "1", "seq")],
    GRANT: [(HOLDING, "user_id", "item_id", "quantity", "NULL", "seq")],
    STOCK_ADD: [
        (STOCK, "item_id", "0", "-quantity", "quantity", "seq"),
        (HOLDING, "user_id", "item_id", "quantity", "NULL", "seq"),
    ],
    STOCK_REMOVE: [
        (HOLDING, "user_id", "item_id", "-1", "1", "seq"),
        (STOCK, "item_id", "0", "1", "NULL", "seq"),
    ],
    REWARD: [(CASH, "user_id", "0", "coalesce(coins, 0)", "IF(need > 0, need, NULL)", "seq")],
}
# Postings that some requests of a kind have: (when, posting), each when implies those before it. A cancellation hands
# back listed less sold. The quantity of a listed offer matters if a request names it, so that it is in the directory.
FURTHER = {
    LIST: [
        ("o_seller IS NOT NULL", (OFFER, "offer_id", "0", "quantity", "NULL", "seq")),
        ("closing_seq IS NOT NULL", (HOLDING, "user_id", "item_id", "quantity", "NULL", "closing_seq")),
    ],
    MARKET_BUY: [("closing_seq IS NOT NULL", (HOLDING, "o_seller", "o_item", "-quantity", "NULL", "closing_seq"))],
    REWARD: [("item_id IS NOT NULL", (HOLDING, "user_id", "item_id", "1", "NULL", "seq"))],
}
# Requests of a kind without guards are settled from the start.
CERTAIN = f"kind = '{GRANT}'"


def _postings(live: DataFrame, *more: str) -> DataFrame:
    """Postings of the requests that accounts decide, with further columns of their requests."""

    def struct(posting: tuple, lead: bool) -> str:
        account, a, b, coef, need, at_seq = posting
        return f"""named_struct('account', '{account}', 'a', {a}, 'b', CAST({b} AS BIGINT), 'at_seq', {at_seq},
            'coef', CAST({coef} AS BIGINT), 'need', CAST({need} AS BIGINT), 'lead', {str(lead).lower()})"""

    branches = []
    for kind, postings in SHARED.items():
        always = [struct(posting, i == 0) for i, posting in enumerate(postings)]
        longer = [f"WHEN kind = '{kind}' THEN array({', '.join(always)})"]
        for when, posting in FURTHER.get(kind, []):
            always.append(struct(posting, False))
            longer.insert(0, f"WHEN kind = '{kind}' AND {when} THEN array({', '.join(always)})")
        branches += longer
    return live.selectExpr(
        "seq",
        "doom IS NOT NULL AS doomed",
        f"IF(kind = '{STOCK_REMOVE}', quantity, CAST(1 AS BIGINT)) AS cap",
        f"inline(CASE {' '.join(branches)} END) AS (account, a, b, at_seq, coef, need, lead)",
        *more,
    ).select(*COLUMNS, "doomed", *more)


def _opening(users: DataFrame, items: DataFrame, inventory: DataFrame, directory: DataFrame) -> DataFrame:
    """Amounts before the first request, and what a cancellation returns of a stored offer."""
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")

    def amounts(df: DataFrame, account: str, a: str, b: Column, amount: str, at: Column) -> DataFrame:
        return df.select(
            nothing.alias("seq"), F.lit(account).alias("account"), F.col(a).alias("a"), b.alias("b"),
            at.alias("at_seq"), F.col(amount).alias("coef"), F.lit(1).cast("bigint").alias("cap"),
            nothing.alias("need"), F.lit(False).alias("lead"),
        )

    stored = directory.filter(F.col("o_open") > 0)
    return reduce(
        DataFrame.unionByName,
        [
            amounts(users, CASH, "id", zero, "balance", zero),
            amounts(items, STOCK, "id", zero, "stock", zero),
            amounts(inventory, HOLDING, "user_id", F.col("item_id"), "quantity", zero),
            amounts(stored, OFFER, "offer_id", zero, "o_open", zero),
            amounts(
                stored.filter(F.col("closing_seq").isNotNull()),
                HOLDING, "o_seller", F.col("o_item"), "o_open", F.col("closing_seq"),
            ),
        ],
    )


def _reasons() -> Column:
    """Reason of a refused request from the amounts it found, in the order of the checks."""
    kind, q = F.col("kind"), F.col("quantity")
    stock, cash, held, left = (F.coalesce(f"found_{a}", F.lit(0)) for a in (STOCK, CASH, HOLDING, OFFER))
    short_cash = cash < F.when(kind == REWARD, F.col("need")).otherwise(F.col("cost"))
    return F.coalesce(
        F.col("refusal"),
        F.when((kind == BUY) & (stock == 0), F.lit("out_of_stock")),
        F.when(kind.isin(BUY, STOCK_ADD) & (stock < q), F.lit("short_stock")),
        F.when(kind.isin(SELL, LIST) & (held < q), F.lit("short_holding")),
        F.when((kind == STOCK_REMOVE) & (held < 1), F.lit("short_holding")),
        F.when(kind.isin(MARKET_BUY, CANCEL) & (left < 1), F.lit("offer_closed")),
        F.when((kind == MARKET_BUY) & (left < q), F.lit("short_offer")),
        F.when(F.col("doom").isin("unknown_user", "unknown_item"), F.col("doom")),
        F.when(kind.isin(BUY, MARKET_BUY, REWARD) & short_cash, F.lit("short_balance")),
        F.col("doom"),
    )


def _moved(accepted: DataFrame, account: str) -> DataFrame:
    """Net accepted movement per account of one sort."""
    return (
        _movements(accepted)
        .filter(F.col("account") == account)
        .groupBy("a", "b")
        .agg(F.sum("moved").alias("moved"))
        .filter(F.col("moved") != 0)
    )


def _movements(settled: DataFrame) -> DataFrame:
    return _postings(settled, "units").withColumn("moved", F.col("coef") * F.col("units"))


def _running(movements: DataFrame, block_rows: int, hot: list[int]) -> DataFrame:
    """Movements, and the guards of refused requests, with what their accounts held before them."""
    asked = movements.filter("moved <> 0 OR (need IS NOT NULL AND units = 0)")
    # What takes effect together is one movement.
    late = F.col("at_seq") > F.coalesce("seq", F.lit(0))
    lumped = asked.filter(late).groupBy(*ACCOUNT, "at_seq").agg(F.sum("moved").alias("moved"))
    own = asked.filter(~late).select("seq", *ACCOUNT, "at_seq", "need", "units", "moved")
    return running_before(own.unionByName(lumped, allowMissingColumns=True), ACCOUNT, "at_seq", ["moved"], block_rows, hot)


STARTED = "at_seq > 0 AND moved > 0 AND before_moved <= 0"


def _new_inventory(inventory: DataFrame, moves: DataFrame, running: DataFrame, facts: DataFrame) -> DataFrame:
    """Holdings after all accepted movements.

    A holding that was used up ends there: what is gained later is a new one
    with the time of that gain.
    """
    times = (
        running.filter(STARTED)
        .groupBy("a", "b")
        .agg(F.max("at_seq").alias("seq"))
        .join(facts.select("seq", "at"), "seq")
        .groupBy(F.col("a").alias("user_id"), F.col("b").alias("item_id"))
        .agg(F.max("at").alias("started"))
    )
    keys = ["user_id", "item_id"]
    amounts = (
        moves.groupBy(F.col("a").alias("user_id"), F.col("b").alias("item_id"))
        .agg(F.sum("moved").alias("quantity"))
        .filter(F.col("quantity") > 0)
    )
    return (
        amounts.join(times, keys, "left")
        .join(inventory.select(*keys, "purchased_at"), keys, "left")
        .select(*keys, "quantity", F.coalesce("started", "purchased_at").alias("purchased_at"))
    )


def _new_offers(offers: DataFrame, accepted: DataFrame) -> DataFrame:
    """Stored and newly listed offers with what was sold or cancelled."""
    columns = ["id", "seller_id", "item_id", "quantity", "price_per_unit", "status", "created_at", "sold_at"]
    stored = offers if "sold_at" in offers.columns else offers.withColumn("sold_at", F.lit(None).cast("timestamp_ntz"))
    listed = accepted.filter(F.col("kind") == LIST).select(
        F.col("offer_id").alias("id"),
        F.col("user_id").alias("seller_id"),
        "item_id",
        "quantity",
        "price_per_unit",
        F.lit("active").alias("status"),
        F.col("at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("sold_at"),
    )
    bought = F.col("kind") == MARKET_BUY
    events = (
        accepted.filter(F.col("kind").isin(MARKET_BUY, CANCEL))
        .groupBy(F.col("offer_id").alias("_offer"))
        .agg(
            F.sum(F.when(bought, F.col("quantity")).otherwise(0)).alias("_sold"),
            F.max_by("quantity", F.when(bought, F.col("seq"))).alias("_last_quantity"),
            F.max_by("at", F.when(bought, F.col("seq"))).alias("_last_at"),
            F.max(F.col("kind") == CANCEL).alias("_cancelled"),
        )
    )
    remaining = F.col("quantity") - F.coalesce("_sold", F.lit(0))
    closed = F.col("_offer").isNotNull() & (remaining == 0)
    return (
        stored.select(*columns)
        .unionByName(listed)
        .join(events, F.col("id") == F.col("_offer"), "left")
        .withColumns(
            {
                # A sold-out offer keeps the quantity of its last purchase.
                "quantity": F.when(closed, F.col("_last_quantity")).otherwise(remaining),
                "status": F.when(closed, "sold").when(F.col("_cancelled"), "cancelled").otherwise(F.col("status")),
                "sold_at": F.when(closed, F.col("_last_at")).otherwise(F.col("sold_at")),
            }
        )
        .select(*columns)
    )


def _shop_log(accepted: DataFrame) -> DataFrame:
    types = {BUY: "purchase", SELL: "sale", GRANT: "admin_grant"}
    kind = reduce(lambda c, pair: c.when(F.col("kind") == pair[0], F.lit(pair[1])), list(types.items())[1:], F.when(F.col("kind") == BUY, "purchase"))
    return accepted.filter(F.col("kind").isin(*types)).select(
        F.col("seq").alias("id"), "user_id", "item_id", "quantity", kind.alias("transaction_type"),
        F.col("unit").alias("price_per_unit"), F.col("cost").alias("total_amount"), F.col("at").alias("transaction_date"),
    )


def replay(
    requests: DataFrame,
    users: DataFrame,
    items: DataFrame,
    inventory: DataFrame,
    offers: DataFrame,
    block_rows: int = BLOCK_ROWS,
    **blocks: int,
) -> Replay:
    """Run numbered requests against snapshots with the result of running them in order.

    ``requests`` has ``seq`` (dense, from 1), ``kind``, ``user_id``, ``at`` and
    what the kind needs: ``item_id``, ``offer_id``, ``quantity``,
    ``price_per_unit`` (list), ``need`` and ``coins`` (reward). ``blocks`` are the
    block sizes of ``settle``.
    """
    shaped = _shaped(requests)
    kinds = {row.kind for row in shaped.filter(F.col("kind").isin(*KINDS)).select("kind").distinct().collect()}
    # Offers are looked at only if a request is about one.
    met = offers if kinds & {LIST, MARKET_BUY, CANCEL} else offers.filter(F.lit(False))
    # Without listings no id is a new one.
    first_new = met.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("first")).first()[0] if LIST in kinds else 0
    named = _named(shaped, first_new) if LIST in kinds else shaped
    directory = stored(_directory(named, met, first_new), "directory")
    listings = stored(directory.filter("o_seq > 0"), "listings")
    judged = _enriched(named, users, items, directory, listings).withColumns(
        {"refusal": _static_refusal(), "doom": _doomed()}
    )
    facts = stored(judged.drop("user_known", "item_known", "item_price", "o_price", "o_open", "o_seq"), "facts")
    repeated = facts.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR seq IS NULL").first()
    if repeated:
        raise ValueError(f"request position {repeated.seq} is missing or given more than once")
    opening = _opening(users, items, inventory, directory)
    # Doomed requests are decided, but their guards are kept to report what they found.
    live = facts.filter(F.col("refusal").isNull())
    asking = _postings(live, "kind").selectExpr(
        f"IF({CERTAIN}, NULL, seq) AS seq", *[name for name in COLUMNS if name not in ("seq", "lead")],
        f"lead AND NOT ({CERTAIN}) AS lead", "doomed",
    )
    postings = stored(asking.unionByName(opening.withColumn("doomed", F.lit(False))), "postings")
    hot = hot_buckets(postings, ACCOUNT, block_rows)
    verdicts, rounds = settle(postings.filter(~F.col("doomed")), block_rows, hot=hot, **blocks)
    dropped(postings)
    certain = F.expr(f"IF(refusal IS NULL AND {CERTAIN}, 1, 0)")
    settled = facts.join(verdicts, "seq", "left").withColumn("units", F.coalesce("units", certain))

    asked, accepted = settled.filter(F.col("refusal").isNull()), settled.filter("units > 0")
    opened = opening.withColumns({"units": F.col("cap"), "moved": F.col("coef")})
    # Amounts found by the guards of refused requests.
    found = (
        _running(_movements(asked).unionByName(opened, allowMissingColumns=True), block_rows, hot)
        .filter("need IS NOT NULL AND units = 0")
        .groupBy("seq")
        .agg(
            *[
                F.max(F.when(F.col("account") == account, F.col("before_moved"))).alias(f"found_{account}")
                for account in (STOCK, CASH, HOLDING, OFFER)
            ]
        )
    )
    decisions = (
        settled.withColumn("accepted", F.col("units") > 0)
        .join(found, "seq", "left")
        .withColumn("reason", F.when(~F.col("accepted"), _reasons()))
    )
    moves = _movements(accepted).unionByName(opened, allowMissingColumns=True).filter(F.col("account") == HOLDING)

    cash, stock = _moved(accepted, CASH), _moved(accepted, STOCK)
    new_users = (
        users.join(cash.select(F.col("a").alias("id"), "moved"), "id", "left")
        .withColumn("balance", F.col("balance") + F.coalesce("moved", F.lit(0)))
        .select(*users.columns)
    )
    new_items = (
        items.join(stock.select(F.col("a").alias("id"), "moved"), "id", "left")
        .withColumn("stock", F.col("stock") + F.coalesce("moved", F.lit(0)))
        .select(*items.columns)
    )
    trades = accepted.filter(F.col("kind") == MARKET_BUY).select(
        F.col("seq").alias("id"), "offer_id", F.col("o_item").alias("item_id"), "quantity",
        F.col("unit").alias("price_per_unit"), F.col("cost").alias("total_amount"), F.col("at").alias("transaction_date"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.col("user_id"), F.lit("buyer").alias("role")),
            F.struct(F.col("o_seller").alias("user_id"), F.lit("seller").alias("role")),
        )
    )
    participants = (
        accepted.filter(F.col("kind") == MARKET_BUY)
        .select(F.col("seq").alias("transaction_id"), sides.alias("side"))
        .select("transaction_id", "side.user_id", "side.role")
    )
    return Replay(
        decisions=decisions.select("seq", "kind", "user_id", "item_id", "offer_id", "quantity", "units", "accepted", "reason"),
        users=new_users,
        items=new_items,
        inventory=_new_inventory(inventory, moves, _running(moves, block_rows, hot), settled),
        offers=_new_offers(offers, accepted),
        transactions=_shop_log(accepted),
        trades=trades,
        participants=participants,
        rounds=rounds,
    )
