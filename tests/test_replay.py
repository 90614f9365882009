"""The distributed replay against the one-by-one model on random tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from sequential import Shop
from tradeloom.operators import replay as R

DAY = dt.datetime(2024, 1, 1)
REQUESTS = ", ".join(f"{name} {kind}" for name, kind in R.REQUEST_COLUMNS.items())
SHOP_KINDS = (R.BUY, R.SELL)
ALL_KINDS = R.KINDS


def make(seed: int, n: int, users: int, items: int, kinds=ALL_KINDS, hot: float = 0.0):
    """Small random tables; ``hot`` is the share of requests on the first user or item."""
    rng = random.Random(seed)
    people = [(u, rng.choice([-50, 0, 100, 500, 3000])) for u in range(1, users + 1)]
    goods = [(i, rng.randint(0, 60), rng.choice([0, 3, 30])) for i in range(1, items + 1)]
    held = [(u, i, rng.randint(1, 9)) for u in range(1, users + 1) for i in range(1, items + 1) if rng.random() < 0.3]
    offers = [
        (o, rng.randint(1, users), rng.randint(1, items), rng.randint(0, 40), rng.randint(1, 9),
         rng.choice(["active", "active", "active", "sold", "cancelled"]))
        for o in range(1, max(2, n // 20) + 1)
    ]
    open_ids = [o[0] for o in offers]
    base = max(open_ids) + 1
    listed, requests = [], []
    for seq in range(1, n + 1):
        kind = rng.choice(kinds)
        user = 1 if rng.random() < hot else rng.randint(1, users + (rng.random() < 0.05))
        item = 1 if rng.random() < hot else rng.randint(1, items + (rng.random() < 0.05))
        offer = price = None
        need = coins = None
        if kind == R.LIST:
            price = rng.randint(-1 if rng.random() < 0.1 else 0, 40)
            listed.append((base + seq, user))
        if kind in (R.MARKET_BUY, R.CANCEL):
            choices = open_ids + [o for o, _ in listed] + [base + seq + 3, 999_999]
            offer = open_ids[0] if rng.random() < hot else rng.choice(choices)
            if kind == R.CANCEL:
                owner = {o[0]: o[1] for o in offers} | dict(listed)
                user = owner.get(offer, user) if rng.random() < 0.8 else user
        if kind == R.REWARD:
            need, coins = rng.choice([(100, 50), (100, -100), (0, 200), (200, -200), (100, 200)])
            item = rng.choice([None, item])
        quantity = rng.randint(-1 if rng.random() < 0.05 else 1, 6)
        requests.append((seq, kind, user, item, offer, quantity, price, need, coins, DAY + dt.timedelta(minutes=seq)))
    return people, goods, held, offers, requests


def frames(spark, people, goods, held, offers, requests):
    return (
        spark.createDataFrame(requests, REQUESTS),
        spark.createDataFrame(people, "id bigint, balance bigint"),
        spark.createDataFrame(goods, "id bigint, price bigint, stock bigint"),
        spark.createDataFrame([(*h, DAY) for h in held], "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz"),
        spark.createDataFrame(
            [(*o, DAY) for o in offers],
            "id bigint, seller_id bigint, item_id bigint, price_per_unit bigint, quantity bigint, status string, created_at timestamp_ntz",
        ),
    )


def model(people, goods, held, offers, requests):
    shop = Shop(people, goods, held, offers)
    names = list(R.REQUEST_COLUMNS)
    return shop, {row[0]: shop.run(dict(zip(names, row))) for row in requests}


def check(spark, data, **options):
    shop, reasons = model(*data)
    result = R.replay(*frames(spark, *data), **options)
    ours = {r.seq: (r.accepted, r.reason) for r in result.decisions.collect()}
    assert ours == {seq: (reason is None, reason) for seq, reason in reasons.items()}
    assert {r.id: r.balance for r in result.users.collect()} == {u: shop.cash[u] for u, _ in data[0]}
    assert {r.id: r.stock for r in result.items.collect()} == shop.stock
    assert {(r.user_id, r.item_id): r.quantity for r in result.inventory.collect()} == {k: q for k, q in shop.held.items() if q}
    times = {(r.user_id, r.item_id): r.purchased_at for r in result.inventory.collect()}
    assert times == {key: shop.since.get(key, DAY) for key in times}
    offers = {r.id: [r.seller_id, r.item_id, r.price_per_unit, r.quantity, r.status] for r in result.offers.collect()}
    assert offers == shop.offers
    return result, shop


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_kinds_agree_with_the_model(spark, seed):
    check(spark, make(seed, 400, 25, 12))


def test_long_chains_take_few_rounds(spark):
    """Almost every request depends on all before it, and no block holds more than a sixth of them."""
    result, _ = check(spark, make(5, 600, 3, 2, SHOP_KINDS), block_requests=100, first_block=25)
    assert result.rounds <= 12


@pytest.mark.parametrize("seed", [21, 22])
def test_all_kinds_in_small_blocks(spark, seed):
    check(spark, make(seed, 300, 12, 6), block_requests=30, first_block=5)


def test_separate_markets_have_blocks_of_their_own(spark):
    """Three shops of two users and one item each, side by side: flocks of 100 requests."""
    rng = random.Random(4)
    people, goods = [(u, 300) for u in range(1, 7)], [(i, 40, 20) for i in range(1, 4)]
    requests = []
    for seq in range(1, 301):
        shop = rng.randrange(3)
        kind = rng.choice(SHOP_KINDS)
        user = 2 * shop + rng.randint(1, 2)
        requests.append((seq, kind, user, shop + 1, None, rng.randint(1, 4), None, None, None, DAY))
    result, _ = check(spark, (people, goods, [], [], requests), block_requests=110, first_block=20)
    assert result.rounds <= 6


def test_hot_user_item_and_offer_in_small_blocks(spark):
    check(spark, make(7, 600, 30, 15, hot=0.4), block_rows=50)


def test_market_only(spark):
    check(spark, make(9, 500, 10, 4, (R.LIST, R.MARKET_BUY, R.CANCEL, R.GRANT)))


def test_dense_requests_agree_with_the_model(spark):
    """25 users and 12 items with 1,500 purchases and sales: almost every request depends on all before it."""
    result, _ = check(spark, make(11, 1500, 25, 12, SHOP_KINDS))
    assert result.rounds <= 2


def test_repeated_positions_are_refused(spark):
    requests, *rest = frames(spark, *make(1, 10, 5, 3))
    with pytest.raises(ValueError, match="position 3"):
        R.replay(requests.union(requests.filter("seq = 3")), *rest)


def test_nothing_to_do(spark):
    people, goods, held, offers, _ = make(1, 10, 5, 3)
    requests, *rest = frames(spark, people, goods, held, offers, [])
    result = R.replay(requests, *rest)
    assert result.decisions.count() == 0
    assert result.users.count() == len(people)


def test_logs_conserve_money_and_goods(spark):
    data = make(13, 400, 20, 10)
    result, shop = check(spark, data)
    from pyspark.sql import functions as F

    log = result.transactions.groupBy("transaction_type").agg(F.sum("total_amount").alias("total")).collect()
    paid = {row.transaction_type: row.total for row in log}
    game = sum(
        row[8] for row in data[4] if row[1] == R.REWARD and row[0] in {r.seq for r in result.decisions.filter("accepted").collect()}
    )
    before = sum(balance for _, balance in data[0])
    after = result.users.agg(F.sum("balance")).first()[0]
    assert after == before - paid.get("purchase", 0) + paid.get("sale", 0) + game
    assert result.participants.count() == 2 * result.trades.count()


def test_logs_lead_from_the_opening_to_the_closing_snapshots(spark):
    """Shop, trade and escrow movements of a replay account for every difference of its snapshots."""
    from tradeloom.operators import ledger

    data = make(17, 300, 15, 8, (R.BUY, R.SELL, R.LIST, R.MARKET_BUY, R.GRANT))
    requests, users, items, inventory, offers = frames(spark, *data)
    result, _ = check(spark, data)
    opening = ledger.snapshot_entries(users, items, inventory)
    closing = ledger.snapshot_entries(result.users, result.items, result.inventory)
    bought = ledger.trade_entries(result.trades, result.participants).filter("account = 'balance' OR amount > 0")
    listed = result.decisions.filter("kind = 'list' AND accepted").selectExpr(
        "'holding' AS account", "user_id", "item_id", "-quantity AS amount"
    )
    moved = ledger.fold(ledger.shop_entries(result.transactions), bought, listed)
    assert ledger.reconcile(opening, moved, closing).count() == 0
    assert ledger.reconcile(opening, ledger.fold(ledger.shop_entries(result.transactions)), closing).count() > 0


def test_offers_are_read_only_if_a_request_is_about_one(spark):
    """Without listings, market purchases and cancellations no stored offer is looked at; one that is fails here."""
    from pyspark.sql import functions as F

    data = make(23, 120, 8, 5, (R.BUY, R.SELL, R.GRANT))
    requests, users, items, inventory, offers = frames(spark, *data)
    unread = offers.withColumn("id", F.raise_error("offers were read").cast("bigint"))
    got = R.replay(requests, users, items, inventory, unread).decisions
    assert got.exceptAll(R.replay(requests, users, items, inventory, offers).decisions).count() == 0
    assert got.count() == 120


def test_grants_and_unnamed_listings_stay_out_of_the_settlement(spark, monkeypatch):
    """A grant has no guard to wait for, and the quantity of a listing that no request names is never asked for."""
    settled = []
    settle = R.settle

    def seen(postings, *rest, **blocks):
        settled.extend(postings.collect())
        return settle(postings, *rest, **blocks)

    monkeypatch.setattr(R, "settle", seen)
    requests, *rest = frames(spark, *make(24, 60, 6, 4, (R.BUY, R.LIST, R.GRANT)))
    got = R.replay(requests, *rest).decisions.collect()
    assert {r.kind for r in got if r.accepted} == {R.BUY, R.LIST, R.GRANT}
    asked = {r.seq for r in settled if r.seq}
    assert {r.kind for r in got if r.seq in asked} == {R.BUY, R.LIST}
    assert not [r for r in settled if r.account == R.OFFER and r.at_seq > 0]
