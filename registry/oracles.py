"""DuckDB SQL for the registered queries, written from the tables alone."""

from __future__ import annotations

# Logical tables as SQL subqueries over the bound files.
TABLES = {
    "items": """
        SELECT p_partkey AS id, p_name AS name,
               p_name || ' from ' || p_brand || ' made as a ' || p_type || ' piece for the shop' AS description,
               CAST(round(p_retailprice * 100) AS BIGINT) AS price, p_type AS category, p_brand AS rarity,
               p_size AS level_required, split_part(p_name, ' ', 2) AS slot, CAST(100 AS INTEGER) AS durability,
               '{"size": ' || p_size || '}' AS bonus_stats, CAST(p_size % 8 AS BIGINT) AS stock, '' AS image_url,
               TIMESTAMP '2024-01-01' + to_hours(p_partkey % 8760) AS created_at
        FROM part""",
    "users": """
        SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role,
               CAST(round(c_acctbal * 100) AS BIGINT) AS balance,
               TIMESTAMP '2024-01-01' + to_hours(c_custkey % 8760) AS created_at
        FROM customer""",
    "facts": """
        SELECT l_orderkey AS order_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS quantity,
               CASE l_returnflag WHEN 'N' THEN 'purchase' WHEN 'R' THEN 'sale' WHEN 'A' THEN 'admin_grant' END
                   AS transaction_type,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS total_amount,
               CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS price_per_unit,
               l_shipdate AS transaction_date
        FROM lineitem""",
    "transactions": "SELECT o_custkey AS user_id, facts.* FROM facts JOIN orders ON order_id = o_orderkey",
    "order_lines": """
        SELECT orders.*, item_id, quantity, total_amount, supplier_id
        FROM orders JOIN (
            SELECT l_orderkey, min(l_partkey) AS item_id, CAST(sum(l_quantity) AS BIGINT) AS quantity,
                   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_amount,
                   min(l_suppkey) AS supplier_id
            FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "offers": """
        SELECT o_orderkey AS id, o_custkey AS seller_id, item_id, quantity,
               CAST(round(o_totalprice * 100) AS BIGINT) AS price_per_unit,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'sold' ELSE 'cancelled' END AS status,
               o_orderdate AS created_at
        FROM order_lines""",
    "trades": """
        SELECT o_orderkey AS id, o_orderkey AS offer_id, item_id, quantity,
               total_amount // quantity AS price_per_unit, total_amount, o_orderdate AS transaction_date
        FROM order_lines""",
    "participants": """
        SELECT o_orderkey AS transaction_id, o_custkey AS user_id, 'buyer' AS role FROM order_lines
        UNION ALL SELECT o_orderkey, supplier_id, 'seller' FROM order_lines""",
    "inventory": """
        SELECT user_id, item_id, CAST(sum(quantity) AS BIGINT) AS quantity, min(transaction_date) AS purchased_at
        FROM transactions
        WHERE transaction_type = 'admin_grant' GROUP BY user_id, item_id""",
    "game_stats": """
        SELECT event_id AS id, user_id,
               CASE event_type WHEN 'signup' THEN 'wheel' WHEN 'click' THEN 'hunt' WHEN 'purchase' THEN 'chest'
                    ELSE event_type END AS action_type,
               CASE WHEN value >= 20 THEN 'win' ELSE 'lose' END AS result, ts AS created_at
        FROM events""",
    "event_prices": """
        SELECT event_type AS item_id, CAST(round(value * 100) AS BIGINT) AS price_per_unit,
               CAST(1 AS BIGINT) AS quantity, ts AS transaction_date
        FROM events""",
    "trade_rows": """
        SELECT p.user_id, CASE WHEN p.role = 'buyer' THEN 'purchase' ELSE 'sale' END AS type,
               t.transaction_date AS date, i.name AS item_name, t.quantity, t.price_per_unit, t.total_amount, t.item_id,
               (SELECT username FROM users WHERE id = (SELECT min(x.user_id) FROM participants x
                WHERE x.transaction_id = t.id AND x.user_id <> p.user_id)) AS other_party, t.id AS row_id
        FROM trades t JOIN participants p ON p.transaction_id = t.id JOIN items i ON i.id = t.item_id""",
}

# Tables each logical table is built from.
NEEDS = {
    "transactions": ("facts",),
    "offers": ("order_lines",),
    "trades": ("order_lines",),
    "participants": ("order_lines",),
    "inventory": ("transactions",),
    "trade_rows": ("trades", "participants", "items", "users"),
}

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *tables: str) -> None:
    """Register a query text, preceded by the logical tables it reads."""
    ordered: list[str] = []

    def add(table: str) -> None:
        for needed in NEEDS.get(table, ()):
            add(needed)
        if table not in ordered:
            ordered.append(table)

    for table in tables:
        add(table)
    parts = ", ".join(f"{table} AS ({TABLES[table]})" for table in ordered)
    body = sql.strip()
    ORACLES[name] = f"WITH {parts} {body}" if parts else body


def since(days: int, table: str = "lineitem", column: str = "l_shipdate") -> str:
    return f"transaction_date >= (SELECT max({column}) FROM {table}) - INTERVAL {days} DAY"


# Catalog -----------------------------------------------------------------

oracle("catalog_browse", "SELECT * FROM items WHERE category = 'ECONOMY' AND stock > 0", "items")
oracle("catalog_quick_search", "SELECT * FROM items WHERE contains(lower(name), 'red') AND stock > 0", "items")
oracle("indexed_search", "SELECT * FROM items WHERE contains(lower(description), 'bolt from brand#2')", "items")
oracle(
    "advanced_search",
    """SELECT * FROM items WHERE lower(name) LIKE '%bolt%' AND price BETWEEN 90000 AND 150000
       AND level_required BETWEEN 5 AND 40 AND stock > 0""",
    "items",
)
oracle(
    "stock_bands",
    """SELECT *, CASE WHEN stock = 0 THEN 'out' WHEN stock <= 5 THEN 'low' ELSE 'ok' END AS stock_status
       FROM items""",
    "items",
)
oracle("low_stock", "SELECT * FROM items WHERE stock BETWEEN 1 AND 5", "items")
oracle("out_of_stock", "SELECT * FROM items WHERE stock = 0", "items")
oracle(
    "dashboard_counts",
    """SELECT 'users' AS metric, count(*) AS value FROM users UNION ALL SELECT 'items', count(*) FROM items
       UNION ALL SELECT 'out_of_stock', count(*) FROM items WHERE stock = 0""",
    "users", "items",
)
oracle("lookup_users", "SELECT * FROM users WHERE id IN (SELECT o_custkey FROM orders)", "users")
oracle("lookup_items", "SELECT * FROM items WHERE id IN (SELECT l_partkey FROM lineitem)", "items")
oracle(
    "user_balances",
    """SELECT o_orderkey AS user_id, coalesce(balance, 0) AS balance
       FROM orders LEFT JOIN users ON users.id = o_orderkey""",
    "users",
)
oracle("list_users", "SELECT * FROM users", "users")
oracle("item_picklist", "SELECT id, name, category FROM items", "items")
oracle(
    "labelled_items",
    """SELECT id, name,
              CASE category WHEN 'ECONOMY' THEN 'Economy' WHEN 'SMALL' THEN 'Small' ELSE coalesce(category, '-') END
                  AS category_label,
              CASE rarity WHEN 'Brand#1' THEN 'Common' WHEN 'Brand#2' THEN 'Rare' ELSE 'Legendary' END
                  AS rarity_label,
              CASE slot WHEN 'Bolt' THEN 'Fastener' WHEN 'Widget' THEN 'Part' WHEN 'Gear' THEN 'Drive' ELSE 'Loose' END
                  AS slot_label,
              substring(description, 1, 60) AS card_text,
              CASE WHEN length(description) > 50 THEN substring(description, 1, 50) || '...' ELSE description END
                  AS short_text
       FROM items""",
    "items",
)
oracle(
    "labelled_users",
    """SELECT id, username, CASE role WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN 'Works' ELSE 'Other' END
                  AS role_label, balance
       FROM users""",
    "users",
)
oracle(
    "bonus_pairs",
    """SELECT id, 'size' AS stat, CAST(level_required AS VARCHAR) AS amount_text,
              CAST(level_required AS BIGINT) AS amount
       FROM items""",
    "items",
)
oracle(
    "event_props",
    """SELECT event_id, stat, json_extract_string(props, stat) AS amount_text,
              TRY_CAST(json_extract_string(props, stat) AS BIGINT) AS amount
       FROM (SELECT event_id, props, unnest(json_keys(props)) AS stat FROM events)""",
)

# Holdings and market -------------------------------------------------------

oracle(
    "inventory_detail",
    """SELECT user_id, i.id, name, description, price, category, quantity, purchased_at
       FROM inventory JOIN items i ON i.id = item_id""",
    "inventory", "items",
)
oracle(
    "holdings_value",
    """SELECT user_id, count(*) AS item_rows, CAST(sum(price * quantity) AS BIGINT) AS total_value
       FROM inventory JOIN items i ON i.id = item_id GROUP BY user_id""",
    "inventory", "items",
)
oracle(
    "all_users_inventory",
    """, held AS (SELECT user_id, item_id, name, category, quantity FROM items JOIN inventory ON item_id = id)
       SELECT id, username, role, item_id, name AS item_name, category, quantity FROM users, held WHERE user_id = id
       UNION ALL
       SELECT id, username, role, NULL, NULL, NULL, NULL FROM users
       WHERE NOT EXISTS (SELECT 1 FROM held WHERE user_id = users.id)""",
    "users", "inventory", "items",
)
oracle(
    "labelled_inventory",
    """SELECT u.id, username, role, coalesce(i.name, '-') AS item_name, coalesce(i.category, '-') AS category,
              coalesce(CAST(quantity AS VARCHAR), '-') AS quantity
       FROM users u LEFT JOIN inventory inv ON inv.user_id = u.id LEFT JOIN items i ON i.id = inv.item_id""",
    "users", "inventory", "items",
)
def _open_offers(where: str) -> str:
    """Offers chosen first; the names are looked up one by one afterwards."""
    return f"""
        SELECT chosen.*, (SELECT name FROM items WHERE id = chosen.item_id) AS name,
               (SELECT description FROM items WHERE id = chosen.item_id) AS description,
               (SELECT category FROM items WHERE id = chosen.item_id) AS category,
               (SELECT username FROM users WHERE id = chosen.seller_id) AS seller_name
        FROM (FROM offers WHERE {where} AND status = 'active') chosen
        WHERE item_id IN (SELECT id FROM items) AND seller_id IN (SELECT id FROM users)"""


oracle("active_offers", _open_offers("seller_id <> 1"), "offers", "items", "users")
oracle("own_offers", _open_offers("seller_id = 10"), "offers", "items", "users")
oracle("item_offers", _open_offers("item_id BETWEEN 7 AND 7"), "offers", "items", "users")
oracle(
    "trade_details",
    """, named AS (SELECT transaction_id, participants.role, user_id, username FROM participants LEFT JOIN users ON user_id = id),
       buyers AS (SELECT transaction_id, user_id AS buyer_id, username AS buyer_name FROM named WHERE role = 'buyer'),
       sellers AS (SELECT transaction_id, user_id AS seller_id, username AS seller_name FROM named WHERE role = 'seller'),
       sides AS (FROM buyers FULL JOIN sellers USING (transaction_id))
       SELECT trades.*, (SELECT name FROM items WHERE id = trades.item_id) AS item_name,
              buyer_id, buyer_name, seller_id, seller_name
       FROM trades JOIN sides ON sides.transaction_id = trades.id WHERE item_id IN (SELECT id FROM items)""",
    "trades", "items", "participants", "users",
)
oracle(
    "trade_history",
    """SELECT user_id, type, date, item_name, quantity, price_per_unit, total_amount, other_party FROM trade_rows
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, row_id, type) <= 50""",
    "trade_rows",
)
oracle(
    "scarce_history",
    """SELECT user_id, type, date, item_name, quantity, price_per_unit, total_amount, other_party FROM trade_rows
       WHERE item_id IN (SELECT id FROM items WHERE stock > 0)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, row_id, type) <= 3""",
    "trade_rows",
)
oracle(
    "labelled_history",
    """SELECT user_id, CASE type WHEN 'purchase' THEN 'Покупка у игрока' ELSE 'Продажа игроку' END AS type_label,
              strftime(date, '%Y-%m-%d %H:%M') AS date_text, item_name, quantity, price_per_unit, total_amount,
              other_party
       FROM trade_rows QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, row_id, type) <= 5""",
    "trade_rows",
)
oracle(
    "full_history",
    """SELECT user_id, type, date, item_name, quantity, price_per_unit, total_amount, other_party FROM (
           SELECT *, 0 AS source_rank FROM trade_rows
           UNION ALL
           SELECT user_id, 'shop_purchase', transaction_date, name, quantity, price_per_unit, total_amount, item_id,
                  'Магазин', NULL, 1
           FROM transactions JOIN items i ON i.id = item_id WHERE transaction_type = 'purchase')
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC, source_rank, row_id, type, item_id,
                                  quantity, price_per_unit, total_amount) <= 10""",
    "trade_rows", "transactions",
)

# Analytics -----------------------------------------------------------------

oracle(
    "total_stats",
    f"""SELECT count(*) AS total_transactions, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_items_sold,
               CAST(coalesce(sum(total_amount), 0) AS BIGINT) AS total_revenue
        FROM facts WHERE transaction_type = 'purchase' AND {since(30)}""",
    "facts",
)
POPULAR = """SELECT i.id, i.name, i.category, CAST(sum(quantity) AS BIGINT) AS total_sold
    FROM facts JOIN items i ON i.id = item_id WHERE transaction_type = 'purchase' AND {when}
    GROUP BY i.id, i.name, i.category ORDER BY total_sold DESC, i.id LIMIT 10"""
oracle("popular_items", POPULAR.format(when="true"), "facts", "items")
oracle("popular_items_month", POPULAR.format(when=since(30)), "facts", "items")
oracle(
    "category_stats",
    f"""SELECT category, CAST(sum(quantity) AS BIGINT) AS total_sold FROM facts JOIN items i ON i.id = item_id
        WHERE transaction_type = 'purchase' AND {since(365)} GROUP BY category""",
    "facts", "items",
)
for _period, _days, _format in (("week", 7, "%Y-%m-%d"), ("month", 30, "%Y-%m-%d"), ("year", 365, "%Y-%m")):
    oracle(
        f"sales_dynamics_{_period}",
        f"""SELECT strftime(transaction_date, '{_format}') AS date, count(*) AS sales_count,
                   CAST(sum(total_amount) AS BIGINT) AS total_amount
            FROM facts WHERE transaction_type = 'purchase' AND {since(_days)} GROUP BY 1""",
        "facts",
    )
oracle(
    "sales_dynamics_day",
    """SELECT strftime(ts, '%Y-%m-%d %H:00') AS date, count(*) AS sales_count,
              CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_amount
       FROM events WHERE event_type = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
       GROUP BY 1""",
)
PRICES = """SELECT item_id, {label} AS date, round(sum(price_per_unit) / count(*), 4) AS avg_price,
    min(price_per_unit) AS min_price, max(price_per_unit) AS max_price, CAST(sum(quantity) AS BIGINT) AS total_sold
    FROM {table} WHERE {when} GROUP BY 1, 2"""
QUARTER_HOUR = "strftime(make_timestamp((epoch_us(transaction_date) // 900000000) * 900000000), '%Y-%m-%d %H:%M:00')"
oracle(
    "price_history_daily",
    PRICES.format(label="strftime(transaction_date, '%Y-%m-%d')", table="facts", when=since(30)),
    "facts",
)
oracle(
    "price_history_year",
    PRICES.format(label="strftime(transaction_date, '%Y-%m')", table="facts", when=since(365)),
    "facts",
)
oracle(
    "price_candles_day",
    PRICES.format(label=QUARTER_HOUR, table="event_prices", when=since(1, "events", "ts")),
    "event_prices",
)
oracle("price_candles_15m", PRICES.format(label=QUARTER_HOUR, table="event_prices", when="true"), "event_prices")
oracle(
    "game_stats",
    """SELECT user_id, count(*) FILTER (action_type = 'wheel') AS wheel_spins,
              count(*) FILTER (action_type = 'hunt' AND result = 'win') AS hunt_wins,
              count(*) FILTER (action_type = 'hunt' AND result = 'lose') AS hunt_losses,
              count(*) FILTER (action_type = 'chest') AS chests_opened
       FROM game_stats GROUP BY user_id""",
    "game_stats",
)
oracle(
    "daily_action_counts",
    """SELECT user_id, action_type, CAST(created_at AS DATE) AS day, count(*) AS actions
       FROM game_stats GROUP BY 1, 2, 3""",
    "game_stats",
)
oracle(
    "db_summary",
    """SELECT 'users' AS metric, count(*) AS value FROM users
       UNION ALL SELECT 'items', count(*) FROM items
       UNION ALL SELECT 'transactions', count(*) FROM facts
       UNION ALL SELECT 'active_offers', count(*) FROM offers WHERE status = 'active'
       UNION ALL SELECT 'trades', count(*) FROM trades
       UNION ALL SELECT 'game_events', count(*) FROM game_stats
       UNION ALL SELECT 'items_held', CAST(coalesce(sum(quantity), 0) AS BIGINT) FROM inventory
       UNION ALL SELECT 'player_balance', CAST(coalesce(sum(balance), 0) AS BIGINT) FROM users
                 WHERE role <> 'admin'""",
    "users", "items", "facts", "offers", "trades", "game_stats", "inventory",
)

# Imports, exports and tables ------------------------------------------------

oracle(
    "import_items",
    """SELECT CASE WHEN c = 4 THEN '' ELSE name END AS name, CASE WHEN ok THEN '' END AS description,
              CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN category END AS category,
              CASE WHEN ok THEN CASE WHEN c = 5 THEN 'common' ELSE rarity END END AS rarity,
              CASE WHEN ok THEN level_required END AS level_required, CASE WHEN ok THEN 'other' END AS slot,
              CASE WHEN ok THEN 100 END AS durability, CASE WHEN ok THEN bonus_stats END AS bonus_stats,
              CASE WHEN ok THEN CASE WHEN c = 1 THEN 0 ELSE stock END END AS stock,
              CASE WHEN ok THEN '' END AS image_url,
              CASE c WHEN 4 THEN 'unreadable' WHEN 2 THEN 'not_a_number_price' WHEN 3 THEN 'negative_price' END
                  AS reason
       FROM (SELECT *, level_required % 10 AS c, level_required % 10 NOT IN (2, 3, 4) AS ok FROM items)""",
    "items",
)
oracle(
    "export_item_array",
    "SELECT row_number() OVER (ORDER BY id) - 1 AS position, id, name, price, bonus_stats FROM items",
    "items",
)
ORACLES["import_item_arrays"] = ORACLES["import_items"]
oracle(
    "import_users",
    """, file AS (
           SELECT id, 0 AS copy, username, role, balance FROM users
           UNION ALL SELECT id, 1, upper(username), role, balance FROM users WHERE id % 5 = 0),
       judged AS (
           SELECT *, CASE WHEN id % 7 = 0 THEN 'bad_balance' WHEN id % 11 = 0 THEN 'blank_username'
                          WHEN id % 3 = 0 OR copy = 1 THEN 'username_exists' END AS reason
           FROM file)
       SELECT CASE WHEN id % 11 = 0 THEN '' ELSE username END AS username, CASE WHEN reason IS NULL THEN role END AS role,
              CASE WHEN reason IS NULL THEN balance END AS balance, reason
       FROM judged
       UNION ALL SELECT s_name, 'user', 1000, NULL FROM supplier""",
    "users",
)
oracle(
    "export_items",
    "SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM items",
    "items",
)
oracle(
    "export_users",
    "SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM users",
    "users",
)
ALL_TABLES = ("users", "items", "inventory", "transactions", "offers", "trades", "participants", "game_stats")
WIDTHS = {
    "users": 5, "items": 13, "inventory": 4, "transactions": 7, "offers": 7, "trades": 7, "participants": 3,
    "game_stats": 7,
}
oracle(
    "list_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {WIDTHS[t]} AS columns, count(*) AS rows FROM {t}" for t in ALL_TABLES
    ),
    *ALL_TABLES,
)
oracle("table_scan", "SELECT * FROM trades", "trades")

# Audit and changes ----------------------------------------------------------

BROKEN_ROWS = [
    ("users", "not_null:username", "username IS NULL"),
    ("users", "at_least_0:balance", "balance < 0"),
    ("users", "max_length:username", "length(username) > 100"),
    ("users", "max_length:role", "length(role) > 50"),
    ("items", "not_null:name", "name IS NULL"),
    ("items", "not_null:price", "price IS NULL"),
    ("items", "not_null:stock", "stock IS NULL"),
    ("items", "at_least_0:price", "price < 0"),
    ("items", "at_least_0:stock", "stock < 0"),
    ("items", "max_length:name", "length(name) > 200"),
    ("items", "max_length:category", "length(category) > 50"),
    ("items", "max_length:rarity", "length(rarity) > 50"),
    ("items", "max_length:slot", "length(slot) > 50"),
    ("items", "max_length:image_url", "length(image_url) > 500"),
    ("inventory", "not_null:user_id", "user_id IS NULL"),
    ("inventory", "not_null:item_id", "item_id IS NULL"),
    ("inventory", "at_least_1:quantity", "quantity < 1"),
    ("transactions", "not_null:user_id", "user_id IS NULL"),
    ("transactions", "not_null:item_id", "item_id IS NULL"),
    ("transactions", "not_null:quantity", "quantity IS NULL"),
    ("transactions", "not_null:transaction_type", "transaction_type IS NULL"),
    (
        "transactions", "one_of:transaction_type",
        "transaction_type NOT IN ('purchase', 'sale', 'admin_grant', 'admin_remove')",
    ),
    ("offers", "not_null:seller_id", "seller_id IS NULL"),
    ("offers", "not_null:item_id", "item_id IS NULL"),
    ("offers", "not_null:quantity", "quantity IS NULL"),
    ("offers", "not_null:price_per_unit", "price_per_unit IS NULL"),
    ("offers", "at_least_1:quantity", "quantity < 1"),
    ("offers", "at_least_0:price_per_unit", "price_per_unit < 0"),
    ("offers", "one_of:status", "status NOT IN ('active', 'sold', 'cancelled')"),
    ("trades", "not_null:offer_id", "offer_id IS NULL"),
    ("trades", "not_null:item_id", "item_id IS NULL"),
    ("trades", "not_null:quantity", "quantity IS NULL"),
    ("trades", "not_null:price_per_unit", "price_per_unit IS NULL"),
    ("trades", "not_null:total_amount", "total_amount IS NULL"),
    ("participants", "not_null:transaction_id", "transaction_id IS NULL"),
    ("participants", "not_null:user_id", "user_id IS NULL"),
    ("participants", "not_null:role", "role IS NULL"),
    ("participants", "one_of:role", "role NOT IN ('buyer', 'seller')"),
    ("game_stats", "not_null:user_id", "user_id IS NULL"),
    ("game_stats", "not_null:action_type", "action_type IS NULL"),
]
REPEATED_KEYS = [
    ("users", "id"), ("users", "username"), ("items", "id"), ("inventory", "user_id,item_id"), ("offers", "id"),
    ("trades", "id"), ("participants", "transaction_id,user_id"), ("game_stats", "id"),
]
PARENTS = [
    ("inventory", "user_id", "users"), ("inventory", "item_id", "items"),
    ("transactions", "user_id", "users"), ("transactions", "item_id", "items"),
    ("offers", "seller_id", "users"), ("offers", "item_id", "items"),
    ("trades", "offer_id", "offers"), ("trades", "item_id", "items"),
    ("participants", "transaction_id", "trades"), ("participants", "user_id", "users"),
    ("game_stats", "user_id", "users"),
]


def _orphans(where: dict[str, str]) -> list[str]:
    return [
        f"""SELECT '{child}' AS table_name, 'parent:{column}->{parent}' AS rule, count(*) AS violations FROM {child}
            WHERE {column} IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = {child}.{column} AND {where.get(parent, 'true')})"""
        for child, column, parent in PARENTS
    ]


oracle(
    "constraint_audit",
    " UNION ALL ".join(
        [
            f"SELECT '{t}' AS table_name, '{rule}' AS rule, count(*) AS violations FROM {t} WHERE {test}"
            for t, rule, test in BROKEN_ROWS
        ]
        + [
            f"SELECT '{t}', 'unique:{key}', count(*) - count(DISTINCT ({key})) FROM {t}" for t, key in REPEATED_KEYS
        ]
        + _orphans({})
    ),
    *ALL_TABLES,
)
oracle("orphan_check", " UNION ALL ".join(_orphans({"users": "p.balance >= 0", "items": "p.stock > 0"})), *ALL_TABLES)
oracle(
    "cascade_delete",
    """, u AS (SELECT id FROM users WHERE balance >= 0), i AS (SELECT id FROM items WHERE stock <> 0),
       o AS (SELECT * FROM offers WHERE seller_id IN (FROM u) AND item_id IN (FROM i)),
       t AS (SELECT * FROM trades WHERE item_id IN (FROM i) AND offer_id IN (SELECT id FROM o))
       SELECT 'users' AS table_name, count(*) AS rows FROM u
       UNION ALL SELECT 'items', count(*) FROM i
       UNION ALL SELECT 'inventory', count(*) FROM inventory WHERE user_id IN (FROM u) AND item_id IN (FROM i)
       UNION ALL SELECT 'transactions', count(*) FROM transactions WHERE user_id IN (FROM u) AND item_id IN (FROM i)
       UNION ALL SELECT 'offers', count(*) FROM o
       UNION ALL SELECT 'trades', count(*) FROM t
       UNION ALL SELECT 'participants', count(*) FROM participants
                 WHERE user_id IN (FROM u) AND transaction_id IN (SELECT id FROM t)
       UNION ALL SELECT 'game_stats', count(*) FROM game_stats WHERE user_id IN (FROM u)""",
    *ALL_TABLES,
)
NEWEST = "row_number() OVER (PARTITION BY item_id ORDER BY transaction_date DESC, quantity DESC, total_amount DESC) = 1"
oracle(
    "patch_items",
    f"""SELECT i.id, i.name, coalesce(p.price_per_unit, i.price) AS price, coalesce(s.quantity - 10, i.stock) AS stock
        FROM items i
        LEFT JOIN (SELECT * FROM facts WHERE transaction_type = 'purchase' QUALIFY {NEWEST}) p ON p.item_id = i.id
        LEFT JOIN (SELECT * FROM facts WHERE transaction_type = 'sale' AND quantity >= 10 QUALIFY {NEWEST}) s
            ON s.item_id = i.id""",
    "items", "facts",
)
oracle(
    "patch_items_in_place",
    f"""SELECT i.id, i.name, coalesce(p.price_per_unit, i.price) AS price, coalesce(s.quantity - 10, i.stock) AS stock
        FROM items i
        LEFT JOIN (SELECT * FROM facts WHERE transaction_type = 'purchase' QUALIFY {NEWEST}) p
            ON p.item_id = i.id AND i.id % 8 = 1
        LEFT JOIN (SELECT * FROM facts WHERE transaction_type = 'sale' AND quantity >= 10 QUALIFY {NEWEST}) s
            ON s.item_id = i.id AND i.id % 8 = 1""",
    "items", "facts",
)
oracle(
    "patch_items_refused",
    """SELECT CASE WHEN transaction_type = 'sale' THEN 'below_0_stock' ELSE 'nothing_to_update' END AS reason,
              count(*) AS patches
       FROM facts WHERE transaction_type = 'admin_grant' OR (transaction_type = 'sale' AND quantity < 10) GROUP BY 1""",
    "facts",
)
oracle(
    "edit_users",
    """SELECT u.id, username, coalesce(r.o_orderstatus, u.role) AS role,
              coalesce(CAST(round(p.o_totalprice * 100) AS BIGINT), u.balance) AS balance, u.created_at
       FROM users u
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F'
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) r
           ON r.o_custkey = u.id
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F'
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) p
           ON p.o_custkey = u.id""",
    "users",
)
oracle(
    "assign_moderators",
    """SELECT * REPLACE (CASE WHEN id IN (SELECT l_suppkey FROM lineitem) THEN 'moderator' ELSE role END AS role)
       FROM users""",
    "users",
)
oracle(
    "upsert_inventory",
    """, moves AS (SELECT user_id, item_id, CAST(sum(CASE WHEN transaction_type = 'sale' THEN -quantity ELSE quantity END)
                          AS BIGINT) AS delta, min(transaction_date) AS first_at FROM transactions GROUP BY 1, 2)
       SELECT user_id, item_id, coalesce(quantity, 0) + coalesce(delta, 0) AS quantity,
              coalesce(purchased_at, first_at) AS purchased_at
       FROM inventory FULL JOIN moves USING (user_id, item_id)
       WHERE coalesce(quantity, 0) + coalesce(delta, 0) > 0""",
    "inventory", "transactions",
)
SUPPLIER_NAMES = """(SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN ' ' WHEN s_suppkey % 9 <> 1 THEN s_name END AS name
    FROM supplier)"""
oracle(
    "insert_users",
    f"""SELECT * FROM users
       UNION ALL
       SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY s_suppkey), name, 'user', 1000,
              TIMESTAMP '2024-06-01'
       FROM {SUPPLIER_NAMES} WHERE trim(name) <> '' AND name NOT IN (SELECT username FROM users)""",
    "users",
)
oracle(
    "insert_users_refused",
    f"""SELECT 'blank_username' AS reason, 2 * count(*) AS rows FROM {SUPPLIER_NAMES} WHERE coalesce(trim(name), '') = ''
        UNION ALL
        SELECT 'username_exists', (SELECT count(*) FROM users)
                                  + (SELECT count(*) FROM {SUPPLIER_NAMES} WHERE trim(name) <> '')""",
    "users",
)
oracle(
    "insert_items",
    """SELECT * FROM items
       UNION ALL
       SELECT (SELECT max(id) FROM items) + row_number() OVER (ORDER BY name, id), name, description, price, category,
              'common', 1, 'other', 100, NULL, 0, image_url, TIMESTAMP '2024-06-01'
       FROM items WHERE id % 8 > 2""",
    "items",
)
oracle(
    "insert_items_refused",
    """SELECT id AS n, CASE id % 8 WHEN 0 THEN 'missing_name' WHEN 1 THEN 'below_0_price' ELSE 'missing_price' END AS reason
       FROM items WHERE id % 8 <= 2""",
    "items",
)
oracle(
    "rename_users_refused",
    """, asked AS (SELECT o_custkey AS id, o_orderkey AS order_id, o_orderdate AS day,
                          'Customer#' || lpad(CAST(o_orderkey % 4000 AS VARCHAR), 9, '0') AS name FROM orders),
         judged AS (SELECT asked.*, u.id AS holder,
                           row_number() OVER (PARTITION BY name ORDER BY day, order_id) AS turn
                    FROM asked LEFT JOIN users u ON u.username = name)
       SELECT id, order_id, 'username_exists' AS reason FROM judged
       WHERE CASE WHEN holder IS NULL THEN turn > 1 ELSE holder <> id END""",
    "users",
)
LEDGER = """, entries AS (
           SELECT 'balance' AS account, user_id, NULL AS item_id,
                  CASE transaction_type WHEN 'purchase' THEN -total_amount WHEN 'sale' THEN total_amount ELSE 0 END
                      AS amount
           FROM transactions
           UNION ALL SELECT 'stock', NULL, item_id,
                  CASE transaction_type WHEN 'purchase' THEN -quantity WHEN 'sale' THEN quantity ELSE 0 END
           FROM transactions
           UNION ALL SELECT 'holding', user_id, item_id,
                  CASE transaction_type WHEN 'sale' THEN -quantity ELSE quantity END
           FROM transactions
           UNION ALL SELECT 'balance', user_id, NULL, CASE role WHEN 'buyer' THEN -total_amount ELSE total_amount END
           FROM trades JOIN participants ON transaction_id = id
           UNION ALL SELECT 'holding', user_id, item_id, CASE role WHEN 'buyer' THEN quantity ELSE -quantity END
           FROM trades JOIN participants ON transaction_id = id
           UNION ALL SELECT 'holding', seller_id, item_id, -quantity FROM offers WHERE status = 'active'
           UNION ALL SELECT 'balance', user_id, NULL,
                  CAST(trunc(value) AS BIGINT) - CASE event_type WHEN 'purchase' THEN 100 ELSE 0 END
           FROM events)"""
oracle(
    "ledger_fold",
    LEDGER
    + """ SELECT account, user_id, item_id, CAST(sum(amount) AS BIGINT) AS amount FROM entries WHERE amount <> 0
          GROUP BY ALL""",
    "transactions", "trades", "participants", "offers",
)

# Rewards ----------------------------------------------------------------------

# Logged outcomes: every fifth action won an item (some do not exist), lost hunts cost coins.
LOGGED = """
    SELECT event_id AS id, user_id, ts AS created_at,
           CASE event_type WHEN 'signup' THEN 'wheel' WHEN 'click' THEN 'hunt' ELSE 'chest' END AS action_type,
           CASE WHEN event_id % 5 = 0 THEN 'item' ELSE 'coins' END AS reward_type,
           CASE WHEN event_id % 5 = 0 THEN event_id % 2500 + 1
                WHEN event_type = 'click' AND value < 20 THEN -10 * CAST(trunc(value) AS BIGINT)
                ELSE CAST(trunc(value) AS BIGINT) END AS reward_value
    FROM events WHERE event_type IN ('signup', 'click', 'purchase')"""
# One step per user and action: the balance decides, and carries on.
def _rewards(columns: str) -> str:
    return f"""
    WITH RECURSIVE logged AS ({LOGGED}),
    marked AS (
        SELECT *, action_type = 'wheel' AND row_number() OVER (
                   PARTITION BY user_id, action_type, CAST(created_at AS DATE) ORDER BY created_at, id) > 1 AS repeated,
               reward_type = 'item' AND reward_value NOT IN (SELECT p_partkey FROM part) AS unknown
        FROM logged),
    turns AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS turn,
               CASE WHEN action_type = 'chest' THEN 100 WHEN reward_type = 'coins' AND reward_value < 0
                    THEN -reward_value ELSE 0 END AS need,
               CASE WHEN reward_type = 'coins' THEN reward_value ELSE 0 END
                   - CASE WHEN action_type = 'chest' THEN 100 ELSE 0 END AS gain
        FROM marked WHERE NOT repeated AND NOT unknown),
    walk AS (
        SELECT user_id, CAST(0 AS BIGINT) AS turn, CAST(500 AS BIGINT) AS balance, CAST(NULL AS BIGINT) AS id,
               true AS accepted
        FROM (SELECT DISTINCT user_id FROM turns)
        UNION ALL
        SELECT w.user_id, t.turn,
               CAST(CASE WHEN need > 0 AND w.balance < need THEN w.balance ELSE w.balance + gain END AS BIGINT), t.id,
               NOT (need > 0 AND w.balance < need)
        FROM walk w JOIN turns t ON t.user_id = w.user_id AND t.turn = w.turn + 1)
    {columns}"""


# Held lines and won items in one row per user and item.
ORACLES["reward_holdings"] = _rewards(
    """SELECT user_id, item_id, CAST(sum(quantity) AS BIGINT) AS quantity
       FROM (SELECT user_id, item_id, quantity FROM inventory
             UNION ALL SELECT m.user_id, reward_value, 1 FROM marked m JOIN walk w ON w.id = m.id
             WHERE w.accepted AND reward_type = 'item')
       GROUP BY 1, 2"""
).replace("WITH RECURSIVE", "WITH RECURSIVE " + ", ".join(f"{t} AS ({TABLES[t]})" for t in ("facts", "transactions", "inventory")) + ",", 1)
ORACLES["replay_rewards"] = _rewards(
    """SELECT m.id, m.user_id, action_type, reward_type, reward_value, coalesce(accepted, false) AS accepted,
              CASE WHEN repeated THEN 'already_spun' WHEN unknown THEN 'unknown_item'
                   WHEN NOT accepted THEN 'short_balance' END AS reason
       FROM marked m LEFT JOIN walk w ON w.id = m.id"""
)
ORACLES["reward_balances"] = _rewards(
    """SELECT c_custkey AS id, CAST(coalesce((SELECT arg_max(balance, turn) FROM walk WHERE user_id = c_custkey), 500)
              AS BIGINT) AS balance
       FROM customer"""
)

# Streams ---------------------------------------------------------------------

oracle(
    "stream_sales",
    f"""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
               count(*) AS sales_count, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_amount
        FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""",
)
oracle(
    "stream_candles",
    f"""SELECT time_bucket(INTERVAL 15 MINUTE, transaction_date) AS window_start,
               time_bucket(INTERVAL 15 MINUTE, transaction_date) + INTERVAL 15 MINUTE AS window_end, item_id,
               round(sum(price_per_unit) / count(*), 4) AS avg_price, min(price_per_unit) AS min_price,
               max(price_per_unit) AS max_price, CAST(sum(quantity) AS BIGINT) AS total_sold
        FROM event_prices GROUP BY 1, 2, 3""",
    "event_prices",
)
oracle(
    "stream_trailing",
    f"""SELECT step - to_hours(n) AS window_start, step - to_hours(n) + INTERVAL 24 HOUR AS window_end,
               CAST(sum(sales) AS BIGINT) AS sales_count, CAST(sum(amount) AS BIGINT) AS total_amount
        FROM (SELECT date_trunc('hour', ts) AS step, count(*) AS sales,
                     sum(CAST(round(value * 100) AS BIGINT)) AS amount
              FROM events WHERE event_type = 'purchase' GROUP BY 1), range(24) hours(n)
        GROUP BY 1, 2""",
)
oracle("stream_daily_first", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
ORACLES["stream_counters"] = ORACLES["game_stats"]
oracle(
    "stream_upsert",
    """, moves AS (SELECT user_id, CAST(trunc(value) AS BIGINT) AS item_id,
                          CAST(sum(CASE event_type WHEN 'error' THEN -1 ELSE 1 END) AS BIGINT) AS delta, min(ts) AS first_at
                   FROM events GROUP BY 1, 2)
       SELECT user_id, item_id, coalesce(quantity, 0) + coalesce(delta, 0) AS quantity,
              coalesce(purchased_at, first_at) AS purchased_at
       FROM inventory FULL JOIN moves USING (user_id, item_id)
       WHERE coalesce(quantity, 0) + coalesce(delta, 0) > 0""",
    "inventory",
)
# Table, column, type, may be null, key, default, extra.
COLUMNS = """
    users id bigint false PRI - generated
    users username string false UNI - -
    users role string true - user -
    users balance bigint true - 1000 -
    users created_at timestamp_ntz true - - -
    items id bigint false PRI - generated
    items name string false - - -
    items description string true - - -
    items price bigint false - - -
    items category string true - - -
    items rarity string true - common -
    items level_required int true - 1 -
    items slot string true - other -
    items durability int true - 100 -
    items bonus_stats string true - - -
    items stock bigint false - 0 -
    items image_url string true - - -
    items created_at timestamp_ntz true - - -
    inventory user_id bigint false MUL - -
    inventory item_id bigint false MUL - -
    inventory quantity bigint true - 1 -
    inventory purchased_at timestamp_ntz true - - -
"""


def _profile(line: str) -> str:
    table, field, kind, nullable, key, default, extra = ("" if part == "-" else part for part in line.split())
    value = f"'{default}'" if default else "NULL"
    return f"""SELECT '{table}' AS table_name, '{field}' AS field, '{kind}' AS type, {nullable} AS nullable, '{key}' AS key,
        {value} AS default_value, '{extra}' AS extra, count({field}) AS filled FROM {table}"""


oracle(
    "table_profiles", " UNION ALL ".join(_profile(line) for line in COLUMNS.strip().splitlines()), "users", "items", "inventory"
)
ORACLES["rollup_sales_year"] = ORACLES["sales_dynamics_year"]
ORACLES["rollup_candles_day"] = ORACLES["price_candles_day"]
ORACLES["running_audit"] = ORACLES["constraint_audit"]
ORACLES["stream_versioned_holdings"] = ORACLES["stream_upsert"]
# One step per user and event: spend while the balance lasts.
ORACLES["stream_balance_guard"] = """
    WITH RECURSIVE spends AS (
        SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS amount,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn
        FROM events),
    walk AS (
        SELECT user_id, CAST(0 AS BIGINT) AS turn, CAST(100000 AS BIGINT) AS balance, CAST(NULL AS BIGINT) AS event_id,
               false AS accepted
        FROM (SELECT DISTINCT user_id FROM spends WHERE user_id IN (SELECT c_custkey FROM customer))
        UNION ALL
        SELECT w.user_id, s.turn, CASE WHEN amount <= balance THEN balance - amount ELSE balance END, s.event_id,
               amount <= balance
        FROM walk w JOIN spends s ON s.user_id = w.user_id AND s.turn = w.turn + 1)
    SELECT s.event_id, s.user_id, ts, amount, coalesce(accepted, false) AS accepted
    FROM spends s LEFT JOIN walk w ON w.event_id = s.event_id"""
ORACLES["stream_keyed_guard"] = ORACLES["stream_balance_guard"]

# Replays -----------------------------------------------------------------------

# A request depends only on earlier requests of the same users and the same item. Each recursion
# step runs every request that is next in line for all of them, so the steps follow the longest
# line and the result is that of running the requests one by one. The walk holds accounts by key:
# 0 cash of k, 1 stock of k, 4 holding of k and k2, 3 offer k, 2 the outcome of request k.


DECIDED = "requests JOIN walk ON account = 2 AND k = seq"
# Effects of a replay, from the last state of the accounts.
BALANCES = ("k AS id, amount AS balance", "walk WHERE account = 0")
STOCKS = ("k AS id, amount AS stock", "walk WHERE account = 1")
HOLDINGS = (
    "k AS user_id, k2 AS item_id, amount AS quantity, CAST(verdict AS TIMESTAMP) AS purchased_at",
    "walk WHERE account = 4 AND amount > 0",
)


def _shop_replay(kinds: dict[str, str], columns: str, rows: str = DECIDED) -> str:
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in kinds.items())
    tables = ["items", "users", "facts", "transactions", "inventory"]
    return f"""
    WITH RECURSIVE {', '.join(f"{t} AS ({TABLES[t]})" for t in tables)},
    rows AS (
        SELECT CASE transaction_type {cases} END AS kind, user_id, item_id, quantity, transaction_date AS at_time
        FROM transactions WHERE transaction_type IN ({', '.join(f"'{k}'" for k in kinds)})),
    requests AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS user_turn,
               row_number() OVER (PARTITION BY item_id ORDER BY seq) AS item_turn
        FROM (SELECT row_number() OVER (ORDER BY at_time, user_id, item_id, kind, quantity) AS seq, rows.*, price
              FROM rows JOIN items ON items.id = item_id)),
    walk(account, k, k2, amount, turn, verdict) USING KEY (account, k, k2) AS (
        SELECT 0 AS account, id AS k, CAST(0 AS BIGINT) AS k2, balance * 1000 AS amount, CAST(0 AS BIGINT) AS turn,
               CAST(NULL AS VARCHAR) AS verdict
        FROM users
        UNION ALL SELECT 1, id, 0, stock * 40, 0, NULL FROM items
        UNION ALL SELECT 4, user_id, item_id, quantity, 0, CAST(purchased_at AS VARCHAR) FROM inventory
        UNION
        (WITH found AS (
            SELECT r.*, c.amount AS cash, s.amount AS stock, coalesce(h.amount, 0) AS held, h.verdict AS since
            FROM requests r
            JOIN recurring.walk c ON c.account = 0 AND c.k = r.user_id AND c.turn + 1 = r.user_turn
            JOIN recurring.walk s ON s.account = 1 AND s.k = r.item_id AND s.turn + 1 = r.item_turn
            LEFT JOIN recurring.walk h ON h.account = 4 AND h.k = r.user_id AND h.k2 = r.item_id
            WHERE EXISTS (SELECT 1 FROM walk)),
         judged AS (
            SELECT *, CASE
                WHEN kind = 'buy' AND stock = 0 THEN 'out_of_stock'
                WHEN kind IN ('buy', 'stock_add') AND stock < quantity THEN 'short_stock'
                WHEN kind = 'buy' AND cash < price * quantity THEN 'short_balance'
                WHEN kind = 'sell' AND held < quantity THEN 'short_holding'
                WHEN kind = 'stock_remove' AND held = 0 THEN 'short_holding' END AS reason
            FROM found),
         moved AS (
            SELECT *, CASE WHEN reason IS NOT NULL THEN 0 WHEN kind = 'stock_remove' THEN least(quantity, held)
                           ELSE 1 END AS units,
                   CASE WHEN kind = 'stock_remove' THEN 1 ELSE quantity END AS size
            FROM judged)
         SELECT 0, user_id, 0,
                cash + units * CASE kind WHEN 'buy' THEN -price * quantity WHEN 'sell' THEN price // 2 * quantity
                                         ELSE 0 END, user_turn, NULL FROM moved
         UNION ALL
         SELECT 1, item_id, 0,
                stock + units * size * CASE kind WHEN 'grant' THEN 0 WHEN 'buy' THEN -1 WHEN 'stock_add' THEN -1
                                                 ELSE 1 END, item_turn, NULL FROM moved
         UNION ALL
         SELECT 4, user_id, item_id,
                held + units * size * CASE kind WHEN 'sell' THEN -1 WHEN 'stock_remove' THEN -1 ELSE 1 END, 0,
                -- A holding that was used up starts anew.
                CASE WHEN held = 0 THEN CAST(at_time AS VARCHAR) ELSE since END
         FROM moved
         UNION ALL SELECT 2, seq, 0, units, 0, reason FROM moved))
    SELECT {columns} FROM {rows}"""


ORACLES["replay_purchases"] = _shop_replay(
    {"purchase": "buy"}, "seq, user_id, item_id, quantity, amount > 0 AS accepted, verdict AS reason"
)
ORACLES["replay_sales"] = _shop_replay(
    {"admin_grant": "grant", "purchase": "buy", "sale": "sell"},
    "seq, kind, user_id, item_id, quantity, amount > 0 AS accepted, verdict AS reason"
)
ORACLES["replay_admin"] = _shop_replay(
    {"admin_grant": "grant", "purchase": "stock_add", "sale": "stock_remove"},
    "seq, kind, user_id, item_id, quantity, amount AS units, amount > 0 AS accepted, verdict AS reason"
)

_SALES = {"admin_grant": "grant", "purchase": "buy", "sale": "sell"}
ORACLES["replay_sales_balances"] = _shop_replay(_SALES, *BALANCES)
ORACLES["replay_sales_stock"] = _shop_replay(_SALES, *STOCKS)
ORACLES["replay_sales_holdings"] = _shop_replay(_SALES, *HOLDINGS)
_MOVES = {"admin_grant": "grant", "purchase": "stock_add", "sale": "stock_remove"}
ORACLES["replay_admin_holdings"] = _shop_replay(_MOVES, *HOLDINGS)

_MARKET = ["items", "users", "facts", "transactions", "inventory", "order_lines", "offers"]
_MARKET_WALK = f"""
    WITH RECURSIVE {', '.join(f"{t} AS ({TABLES[t]})" for t in _MARKET)},
    rows AS (
        SELECT 'market_buy' AS kind, l_suppkey AS user_id, CAST(NULL AS BIGINT) AS item_id, l_orderkey AS offer_id,
               CAST(l_linenumber AS BIGINT) AS quantity, l_shipdate AS at_time
        FROM lineitem WHERE l_returnflag = 'N'
        UNION ALL SELECT 'cancel', o_custkey, NULL, o_orderkey, NULL, o_orderdate
        FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'list', user_id, item_id, NULL, (quantity + 1) // 2, purchased_at FROM inventory),
    numbered AS (
        SELECT row_number() OVER (ORDER BY at_time, kind, rows.offer_id, user_id, rows.item_id, rows.quantity) AS seq,
               rows.*, seller_id, coalesce(rows.item_id, o.item_id) AS goods, price_per_unit // 100 AS price
        FROM rows LEFT JOIN offers o ON o.id = rows.offer_id),
    touched AS (
        SELECT seq, person, row_number() OVER (PARTITION BY person ORDER BY seq) AS turn
        FROM (SELECT seq, user_id AS person FROM numbered
              UNION SELECT seq, seller_id FROM numbered WHERE seller_id IS NOT NULL)),
    requests AS MATERIALIZED (
        SELECT n.*, a.turn AS user_turn, coalesce(n.seller_id, n.user_id) AS other, b.turn AS other_turn
        FROM numbered n JOIN touched a ON a.seq = n.seq AND a.person = n.user_id
                        JOIN touched b ON b.seq = n.seq AND b.person = coalesce(n.seller_id, n.user_id)),
    walk(account, k, k2, amount, turn, verdict) USING KEY (account, k, k2) AS (
        SELECT 0 AS account, id AS k, CAST(0 AS BIGINT) AS k2, balance * 1000 AS amount, CAST(0 AS BIGINT) AS turn,
               CAST(NULL AS VARCHAR) AS verdict
        FROM users
        UNION ALL SELECT 4, user_id, item_id, quantity, 0, NULL FROM inventory
        UNION ALL SELECT 3, id, 0, quantity, 0, status FROM offers
        UNION
        (WITH found AS (
            SELECT r.*, c.amount AS cash, d.amount AS other_cash, coalesce(h.amount, 0) AS held, o.amount AS remaining,
                   o.verdict AS status
            FROM requests r
            JOIN recurring.walk c ON c.account = 0 AND c.k = r.user_id AND c.turn + 1 = r.user_turn
            JOIN recurring.walk d ON d.account = 0 AND d.k = r.other AND d.turn + 1 = r.other_turn
            LEFT JOIN recurring.walk h ON h.account = 4 AND h.k = r.user_id AND h.k2 = r.goods
            LEFT JOIN recurring.walk o ON o.account = 3 AND o.k = r.offer_id
            WHERE EXISTS (SELECT 1 FROM walk)),
         judged AS (
            SELECT *, CASE
                WHEN kind = 'list' THEN CASE WHEN held < quantity THEN 'short_holding' END
                WHEN status IS NULL OR status <> 'active' THEN 'offer_closed'
                WHEN kind = 'cancel' THEN CASE WHEN user_id <> seller_id THEN 'offer_closed' END
                WHEN quantity > remaining THEN 'short_offer'
                WHEN cash < price * quantity THEN 'short_balance'
                WHEN user_id = seller_id THEN 'own_offer' END AS reason
            FROM found),
         moved AS (SELECT *, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS units FROM judged)
         SELECT 0, user_id, 0, cash - CASE WHEN kind = 'market_buy' THEN units * price * quantity ELSE 0 END,
                user_turn, NULL FROM moved
         UNION ALL
         SELECT 0, other, 0, other_cash + CASE WHEN kind = 'market_buy' THEN units * price * quantity ELSE 0 END,
                other_turn, NULL FROM moved WHERE other <> user_id
         UNION ALL
         SELECT 4, user_id, goods,
                held + units * CASE kind WHEN 'list' THEN -quantity WHEN 'cancel' THEN remaining ELSE quantity END, 0, NULL
         FROM moved WHERE units = 1
         UNION ALL
         SELECT 3, offer_id, 0, CASE WHEN kind = 'cancel' THEN 0 ELSE remaining - quantity END, 0,
                CASE WHEN kind = 'cancel' THEN 'cancelled' WHEN remaining = quantity THEN 'sold' ELSE 'active' END
         FROM moved WHERE units = 1 AND kind <> 'list'
         UNION ALL SELECT 2, seq, 0, units, 0, reason FROM moved)),
    accepted AS (SELECT requests.* FROM requests JOIN walk ON account = 2 AND k = seq WHERE amount > 0)
    """
ORACLES["replay_market"] = _MARKET_WALK + """
    SELECT seq, kind, user_id,
           CASE WHEN kind = 'list' THEN (SELECT max(id) FROM offers) + 1 + seq ELSE offer_id END AS offer_id, quantity,
           amount > 0 AS accepted, verdict AS reason
    FROM requests JOIN walk ON account = 2 AND k = seq"""
ORACLES["market_balances"] = _MARKET_WALK + "SELECT k AS id, amount AS balance FROM walk WHERE account = 0"
ORACLES["market_holdings"] = _MARKET_WALK + """
    SELECT k AS user_id, k2 AS item_id, amount AS quantity FROM walk WHERE account = 4 AND amount > 0"""
ORACLES["market_trades"] = _MARKET_WALK + """
    SELECT seq AS id, offer_id, goods AS item_id, quantity, price AS price_per_unit, price * quantity AS total_amount,
           at_time AS transaction_date
    FROM accepted WHERE kind = 'market_buy'"""
ORACLES["market_participants"] = _MARKET_WALK + """
    SELECT seq AS transaction_id, user_id, 'buyer' AS role FROM accepted WHERE kind = 'market_buy'
    UNION ALL SELECT seq, seller_id, 'seller' FROM accepted WHERE kind = 'market_buy'"""
# A sold-out offer shows the quantity of its last purchase, a cancelled one what was left.
ORACLES["market_offers"] = _MARKET_WALK + """,
    events AS (
        SELECT offer_id, coalesce(sum(quantity) FILTER (kind = 'market_buy'), 0) AS sold, bool_or(kind = 'cancel') AS ended,
               arg_max(quantity, seq) FILTER (kind = 'market_buy') AS last_quantity,
               arg_max(at_time, seq) FILTER (kind = 'market_buy') AS last_at
        FROM accepted WHERE kind <> 'list' GROUP BY offer_id)
    SELECT id, o.seller_id, item_id,
           CAST(CASE WHEN quantity = sold THEN last_quantity ELSE quantity - coalesce(sold, 0) END AS BIGINT) AS quantity,
           CASE WHEN quantity = sold THEN 'sold' WHEN ended THEN 'cancelled' ELSE status END AS status,
           CASE WHEN quantity = sold THEN last_at END AS sold_at
    FROM offers o LEFT JOIN events ON offer_id = id
    UNION ALL
    SELECT (SELECT max(id) FROM offers) + 1 + seq, user_id, goods, quantity, 'active', NULL FROM accepted WHERE kind = 'list'"""
# What the shop lines would have moved had all been accepted, against what the replay left.
ORACLES["ledger_reconcile"] = _shop_replay(
    _SALES,
    "account, user_id, item_id, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual",
    """(SELECT 'balance' AS account, id AS user_id, NULL AS item_id, balance * 1000 AS expected, 0 AS actual FROM users
        UNION ALL SELECT 'stock', NULL, id, stock * 40, 0 FROM items
        UNION ALL SELECT 'holding', user_id, item_id, quantity, 0 FROM inventory
        UNION ALL SELECT 'balance', user_id, NULL,
               CASE kind WHEN 'buy' THEN -price * quantity WHEN 'sell' THEN price // 2 * quantity ELSE 0 END, 0 FROM requests
        UNION ALL SELECT 'stock', NULL, item_id, CASE kind WHEN 'buy' THEN -quantity WHEN 'sell' THEN quantity ELSE 0 END, 0
        FROM requests
        UNION ALL SELECT 'holding', user_id, item_id, CASE kind WHEN 'sell' THEN -quantity ELSE quantity END, 0 FROM requests
        UNION ALL SELECT 'balance', k, NULL, 0, amount FROM walk WHERE account = 0
        UNION ALL SELECT 'stock', NULL, k, 0, amount FROM walk WHERE account = 1
        UNION ALL SELECT 'holding', k, k2, 0, amount FROM walk WHERE account = 4 AND amount > 0)
       GROUP BY ALL HAVING sum(expected) <> sum(actual)""",
)
