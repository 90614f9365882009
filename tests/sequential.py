"""Plain one-by-one replay: the model the distributed replay must agree with."""

from __future__ import annotations

from collections import defaultdict


class Shop:
    """State of the shop; amounts of unknown accounts are 0."""

    def __init__(self, users, items, inventory, offers):
        self.cash = dict(users)
        self.price = {i: price for i, price, _ in items}
        self.stock = {i: stock for i, _, stock in items}
        self.held = defaultdict(int, {(u, i): q for u, i, q in inventory})
        self.since = {}  # holding -> time of its last start within the requests
        # offer id -> [seller, item, price, quantity, status]
        self.offers = {o: [s, i, p, q, st] for o, s, i, p, q, st in offers}
        self.next_offer = max(self.offers, default=0) + 1

    def run(self, r) -> str | None:
        """Apply one request; None when accepted, else the reason."""
        before = {key for key, amount in self.held.items() if amount > 0}
        reason = getattr(self, r["kind"])(r)
        for key, amount in self.held.items():
            if amount > 0 and key not in before:
                self.since[key] = r["at"]
        return reason

    def buy(self, r):
        u, i, q = r["user_id"], r["item_id"], r["quantity"]
        if q <= 0:
            return "bad_quantity"
        if i not in self.price:
            return "unknown_item"
        if self.stock[i] == 0:
            return "out_of_stock"
        if self.stock[i] < q:
            return "short_stock"
        if u not in self.cash:
            return "unknown_user"
        if self.cash[u] < self.price[i] * q:
            return "short_balance"
        self.cash[u] -= self.price[i] * q
        self.stock[i] -= q
        self.held[u, i] += q

    def sell(self, r):
        u, i, q = r["user_id"], r["item_id"], r["quantity"]
        if q <= 0:
            return "bad_quantity"
        if self.held[u, i] < q:
            return "short_holding"
        if i not in self.price:
            return "unknown_item"
        self.cash[u] += self.price[i] // 2 * q
        self.stock[i] += q
        self.held[u, i] -= q

    def list(self, r):
        u, i, q, p = r["user_id"], r["item_id"], r["quantity"], r["price_per_unit"]
        if q <= 0:
            return "bad_quantity"
        if p < 0:
            return "bad_price"
        if self.held[u, i] < q:
            return "short_holding"
        self.held[u, i] -= q
        offer = self.next_offer + r["seq"]
        self.offers[offer] = [u, i, p, q, "active"]

    def market_buy(self, r):
        u, q, offer = r["user_id"], r["quantity"], self.offers.get(r["offer_id"])
        if q <= 0:
            return "bad_quantity"
        if offer is None or offer[4] != "active":
            return "offer_closed"
        seller, item, price, left, _ = offer
        if q > left:
            return "short_offer"
        if u not in self.cash:
            return "unknown_user"
        if self.cash[u] < price * q:
            return "short_balance"
        if u == seller:
            return "own_offer"
        self.cash[u] -= price * q
        self.cash[seller] += price * q
        self.held[u, item] += q
        if q == left:
            offer[4] = "sold"
        else:
            offer[3] -= q

    def cancel(self, r):
        offer = self.offers.get(r["offer_id"])
        if offer is None or offer[0] != r["user_id"] or offer[4] != "active":
            return "offer_closed"
        self.held[offer[0], offer[1]] += offer[3]
        offer[4] = "cancelled"

    def grant(self, r):
        if r["quantity"] <= 0:
            return "bad_quantity"
        if r["item_id"] not in self.price:
            return "unknown_item"
        if r["user_id"] not in self.cash:
            return "unknown_user"
        self.held[r["user_id"], r["item_id"]] += r["quantity"]

    def stock_add(self, r):
        u, i, q = r["user_id"], r["item_id"], r["quantity"]
        if q <= 0:
            return "bad_quantity"
        if i not in self.price:
            return "unknown_item"
        if u not in self.cash:
            return "unknown_user"
        if self.stock[i] < q:
            return "short_stock"
        self.stock[i] -= q
        self.held[u, i] += q

    def stock_remove(self, r):
        u, i, q = r["user_id"], r["item_id"], r["quantity"]
        if q <= 0:
            return "bad_quantity"
        if self.held[u, i] == 0:
            return "short_holding"
        moved = min(q, self.held[u, i])
        self.held[u, i] -= moved
        self.stock[i] += moved

    def reward(self, r):
        u = r["user_id"]
        if r["item_id"] is not None and r["item_id"] not in self.price:
            return "unknown_item"
        if u not in self.cash:
            return "unknown_user"
        if r["need"] and self.cash[u] < r["need"]:
            return "short_balance"
        self.cash[u] += r["coins"]
        if r["item_id"] is not None:
            self.held[u, r["item_id"]] += 1
