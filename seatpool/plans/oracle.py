"""For each registered query, SQL that computes the same from the test tables.

Where the package books in parallel rounds and follows request sequences by
running values, the SQL here goes one group and one request at a time.
"""

from __future__ import annotations

from seatpool import schemas as S
from seatpool.plans.queries import MINIMUM, SWEEP_MINIMUM, VALID_MINIMUM, VENUE_MINIMUM

DAY = "(DATE '2024-01-01' + CAST(dayofyear({}) % 14 AS INTEGER))"
ISO = "strftime({}, '%Y-%m-%d')"
NUMBER = "CAST(split_part({}, '#', 2) AS INTEGER)"


def _iso(column: str) -> str:
    return ISO.format(column)


def _from(title: str) -> str:
    return f"(DATE '2024-01-01' + {NUMBER.format(title)} % 5)"


LINES = """lines AS (
  SELECT o_custkey AS user_id, p_brand AS title_id, o_orderstatus, o_orderdate, l_orderkey,
         l_linenumber, l_suppkey, l_quantity,
         CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS rk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

INTEREST = """interest AS (
  SELECT user_id, title_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_bid
  FROM lines WHERE o_orderstatus = 'O' GROUP BY user_id, title_id)"""

FREE_DAYS = f"""free_days AS (
  SELECT DISTINCT o_custkey AS user_id, {DAY.format('o_orderdate')} AS day
  FROM orders WHERE o_orderstatus = 'O')"""

JOINED = """joined AS MATERIALIZED (
  SELECT i.user_id AS u, f.day AS d, i.title_id AS t, i.total_bid AS bid
  FROM interest i JOIN free_days f ON i.user_id = f.user_id)"""

STATUS = "CASE rk WHEN 1 THEN 'AVAILABLE' WHEN 2 THEN 'BOOKED' ELSE 'EXPIRED' END"

USER_BIDS = f"""user_bids AS (
  SELECT user_id || '_' || title_id AS user_id_title_id, user_id, title_id, {STATUS} AS status,
         num_tickets, ticket_bid, total_bid, {_from('title_id')} AS valid_from,
         {_from('title_id')} + 14 AS valid_to, total_bid % 2 = 0 AS is_preapp
  FROM (SELECT user_id, title_id, rk, CAST(count(*) AS INTEGER) AS num_tickets,
               max(l_quantity) AS ticket_bid,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_bid
        FROM lines GROUP BY user_id, title_id, rk) g
  WHERE rk = (SELECT min(rk) FROM lines l WHERE l.user_id = g.user_id AND l.title_id = g.title_id))"""

USER_TIMESLOTS = f"""user_timeslots AS (
  SELECT user_id, day, {STATUS} AS status, (user_id + day(day)) % 2 = 0 AS is_preapp
  FROM (SELECT o_custkey AS user_id, {DAY.format('o_orderdate')} AS day,
               min(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS rk
        FROM orders GROUP BY ALL) g)"""

TITLES = f"""titles AS (
  SELECT p_brand AS title_id, min(p_name) AS title_name, {_from('p_brand')} AS valid_from,
         {_from('p_brand')} + 14 AS valid_to,
         CASE WHEN {NUMBER.format('p_brand')} > 12 THEN 1 ELSE 0 END AS expired,
         CASE WHEN {NUMBER.format('p_brand')} % 10 <> 0
              THEN 2020 + {NUMBER.format('p_brand')} % 5 END AS year
  FROM part GROUP BY p_brand)"""

REQUESTS = f"""requests AS (
  SELECT event_id AS seq, user_id, event_type, value, CAST(props->>'k' AS INTEGER) AS k,
         'Brand#' || (CAST(props->>'k' AS INTEGER) % 25 + 1) AS title_id,
         {DAY.format('ts')} AS day
  FROM events)"""

VENUES = f"""venue_bids AS MATERIALIZED (
  SELECT user_id AS u, title_id AS t, CAST(l_suppkey % 5 AS VARCHAR) AS v,
         strftime({DAY.format('o_orderdate')} + to_hours(CAST(l_linenumber % 7 * 2 AS BIGINT)),
                  '%Y-%m-%d %H:00') AS ts,
         CAST(l_quantity AS BIGINT) AS bid
  FROM lines WHERE o_orderstatus = 'O')"""


TABLES = f"{LINES}, {INTEREST}, {FREE_DAYS}, {JOINED}"


def greedy(minimum: int, tables: str = TABLES) -> str:
    """One group per step, best first; rows of kind B are booked in their step."""
    return f"""{tables}, st AS (
  SELECT 0 AS step, 'A' AS kind, u, d, t, bid FROM joined
  UNION ALL
  (WITH act AS (SELECT * FROM st WHERE kind = 'A'),
        best AS (SELECT d AS bd, t AS bt, sum(bid) AS s FROM act GROUP BY d, t
                 HAVING sum(bid) > {minimum} ORDER BY s DESC, bd, bt LIMIT 1),
        bu AS (SELECT u FROM act JOIN best ON d = bd AND t = bt)
   SELECT step + 1, CASE WHEN d = bd AND t = bt THEN 'B' ELSE 'A' END, act.u, d, t, bid
   FROM act CROSS JOIN best
   WHERE (d = bd AND t = bt) OR NOT (act.u IN (SELECT u FROM bu) AND (d = bd OR t = bt)))),
booked AS MATERIALIZED (
  SELECT CAST(step AS BIGINT) AS event_rank, u, d, t, bid FROM st WHERE kind = 'B'),
event AS (
  SELECT event_rank, d, t, CAST(sum(bid) AS BIGINT) AS bids_total, count(*) AS num_tickets
  FROM booked GROUP BY event_rank, d, t),
outcome AS (
  SELECT j.u, j.d, j.t, j.bid, min(b.event_rank) AS cause_rank,
         coalesce(bool_or(b.d = j.d AND b.t = j.t), false) AS own
  FROM joined j LEFT JOIN booked b ON b.u = j.u AND (b.d = j.d OR b.t = j.t)
  GROUP BY j.u, j.d, j.t, j.bid)"""


CHANGED = f"""{LINES}, {INTEREST}, {FREE_DAYS}, {REQUESTS}, chg AS (
  SELECT seq, user_id, title_id, day, event_type <> 'error' AS there, k % 40 * 10 + 10 AS bid,
         event_type = 'purchase' OR (event_type = 'error' AND k % 2 = 0) AS of_bid
  FROM requests WHERE event_type IN ('purchase', 'click', 'error')),
last_bid AS (
  SELECT * FROM chg WHERE of_bid
  QUALIFY row_number() OVER (PARTITION BY user_id, title_id ORDER BY seq DESC) = 1),
last_day AS (
  SELECT * FROM chg WHERE NOT of_bid
  QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY seq DESC) = 1),
bids_now AS (
  SELECT user_id, title_id, total_bid AS bid FROM interest
  ANTI JOIN last_bid USING (user_id, title_id)
  UNION ALL SELECT user_id, title_id, bid FROM last_bid WHERE there),
days_now AS (
  SELECT user_id, day FROM free_days ANTI JOIN last_day USING (user_id, day)
  UNION ALL SELECT user_id, day FROM last_day WHERE there),
joined AS MATERIALIZED (
  SELECT b.user_id AS u, f.day AS d, b.title_id AS t, bid
  FROM bids_now b JOIN days_now f ON b.user_id = f.user_id)"""

GREEDY_CHANGED = f"WITH RECURSIVE {greedy(MINIMUM, CHANGED)}"

GREEDY = f"WITH RECURSIVE {greedy(MINIMUM)}"

JOINED_VALID = f"""{LINES}, {FREE_DAYS}, held AS (
  SELECT user_id, title_id, CAST(l_quantity AS BIGINT) AS bid, l_linenumber AS n,
         DATE '2024-01-01' + CAST(l_orderkey % 12 AS INTEGER) AS since
  FROM lines WHERE o_orderstatus = 'O'),
joined AS MATERIALIZED (
  SELECT h.user_id AS u, f.day AS d, h.title_id AS t, bid
  FROM held h JOIN free_days f ON h.user_id = f.user_id
   AND f.day BETWEEN since AND since + CAST(n - 1 AS INTEGER))"""

GREEDY_VALID = f"WITH RECURSIVE {greedy(VALID_MINIMUM, JOINED_VALID)}"

SHOW_EVENTS = f"""{GREEDY}, {TITLES}, show_event AS (
  SELECT t || '_' || {_iso('d')} AS title_id_day, t AS title_id, title_name, valid_from, valid_to,
         coalesce(CAST(year AS VARCHAR), '') AS year, d AS day,
         CASE WHEN 200 - num_tickets <= 0 THEN 'FULL' ELSE 'AVAILABLE' END AS status,
         200 - num_tickets AS num_tickets_available,
         CAST(ceil(CAST(bids_total * 5 AS DECIMAL(38, 10)) / (num_tickets * 4)) AS BIGINT) AS ticket_price
  FROM event JOIN titles ON t = title_id)"""

SHOW_EVENT_COLUMNS = f"""title_id_day, title_id, title_name, {_iso('valid_from')} AS "from",
  {_iso('valid_to')} AS "to", year, {_iso('day')} AS day, status, num_tickets_available,
  ticket_price"""

APPLIED = f"""WITH {LINES}, {USER_BIDS}, {USER_TIMESLOTS}, {TITLES}, {REQUESTS}, msg AS (
  SELECT seq, user_id, day, title_id,
         row_number() OVER (PARTITION BY user_id, title_id ORDER BY seq) AS nth
  FROM requests WHERE event_type = 'purchase'),
seen AS MATERIALIZED (
  SELECT m.*, b.status AS bid_status, s.status AS slot_status,
         coalesce(nth = 1 AND b.status = 'AVAILABLE', false) AS won
  FROM msg m LEFT JOIN user_bids b ON b.user_id = m.user_id AND b.title_id = m.title_id
  LEFT JOIN user_timeslots s ON s.user_id = m.user_id AND s.day = m.day),
judged AS MATERIALIZED (
  SELECT *, won AND coalesce(slot_status = 'AVAILABLE', false)
            AND row_number() OVER (PARTITION BY user_id, day, won ORDER BY seq) = 1 AS placed
  FROM seen),
booking AS (
  SELECT j.user_id || '_' || j.title_id || '_' || {_iso('j.day')} AS user_id_event_id,
         'BOOKED' AS status, b.is_preapp, b.num_tickets, b.ticket_bid, j.user_id, j.day,
         j.title_id, j.title_id || '_' || {_iso('j.day')} AS event_id, title_name,
         year AS title_year
  FROM judged j JOIN user_bids b ON b.user_id = j.user_id AND b.title_id = j.title_id
  JOIN titles t ON t.title_id = j.title_id WHERE placed)"""

BOOKING_COLUMNS = f"""user_id_event_id, status, is_preapp, num_tickets, ticket_bid, user_id,
  {_iso('day')} AS day, title_id, event_id, title_name, title_year"""


def _machine(rows) -> str:
    def text(value) -> str:
        return "NULL" if value is None else f"'{value}'"

    lines = ",".join(
        f"({text(old)}, {text(new)}, {str(ok).lower()}, {text(message)})"
        for old, new, ok, message in rows
    )
    return f"machine(old_status, new_status, accepted, message) AS (VALUES {lines})"


def _fold(key: str, table: str) -> str:
    """Requests of a key one after the other, from the table's status."""
    one, two = key.split(", ")
    return f"""valid AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS nth
  FROM asked WHERE refusal IS NULL),
fold AS (
  SELECT v.seq, v.{one}, v.{two}, nth, m.accepted AS ok, m.message,
         CASE WHEN m.accepted THEN v.status ELSE s.status END AS status
  FROM valid v LEFT JOIN {table} s ON s.{one} = v.{one} AND s.{two} = v.{two}
  LEFT JOIN machine m ON m.old_status IS NOT DISTINCT FROM s.status AND m.new_status = v.status
  WHERE nth = 1
  UNION ALL
  SELECT v.seq, v.{one}, v.{two}, v.nth, m.accepted, m.message,
         CASE WHEN m.accepted THEN v.status ELSE f.status END
  FROM fold f JOIN valid v ON v.{one} = f.{one} AND v.{two} = f.{two} AND v.nth = f.nth + 1
  LEFT JOIN machine m ON m.old_status IS NOT DISTINCT FROM f.status AND m.new_status = v.status),
answered AS MATERIALIZED (
  SELECT seq, {key}, coalesce(ok, false) AS ok, coalesce(message, 'undefined transition') AS message
  FROM fold
  UNION ALL SELECT seq, {key}, false, refusal FROM asked WHERE refusal IS NOT NULL),
taken AS (
  SELECT v.* FROM valid v JOIN answered a ON a.seq = v.seq WHERE a.ok)"""


RESULT = """CASE WHEN ok THEN '"success"'
  ELSE '{"reason":"client_error","errors":["' || message || '"]}' END AS result"""

CHANGES = """changes AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'cancel' ELSE 'put' END AS op,
         CASE event_type WHEN 'error' THEN 'CANCELED_BY_USER' ELSE 'AVAILABLE' END AS status
  FROM requests WHERE event_type IN ('purchase', 'click', 'error'))"""

BID_ASKED = f"""asked AS (
  SELECT c.seq, c.op, c.user_id, c.title_id, c.status,
         CASE WHEN k % 3 <> 0 THEN k % 7 + 1 ELSE 1 END AS num_tickets,
         CAST(value AS DECIMAL(10, 2)) AS ticket_bid, day AS valid_from, day + 7 AS valid_to,
         k % 4 <> 0 AS is_preapp,
         CASE WHEN op = 'put' THEN
           CASE WHEN t.title_id IS NULL THEN 'no such title'
                WHEN NOT (TIMESTAMP '2024-01-03' BETWEEN t.valid_from AND t.valid_to)
                THEN 'title is expired' END END AS refusal
  FROM changes c LEFT JOIN titles t ON t.title_id = c.title_id)"""

BID_REQUESTS = f"""WITH RECURSIVE {LINES}, {USER_BIDS}, {TITLES}, {REQUESTS}, {CHANGES},
{_machine(S.BID_TRANSITIONS)}, {BID_ASKED}, {_fold('user_id, title_id', 'user_bids')}"""

SLOT_REQUESTS = f"""WITH RECURSIVE {USER_TIMESLOTS}, {REQUESTS}, {CHANGES},
{_machine(S.TIMESLOT_TRANSITIONS)}, asked AS (
  SELECT seq, op, user_id, day, status, k % 4 <> 0 AS is_preapp,
         CASE WHEN op = 'put' AND day < DATE '2024-01-03' THEN 'day is in the past'
              WHEN op = 'put' AND day > DATE '2024-01-03' + 365
              THEN 'day too far off in the future' END AS refusal
  FROM changes), {_fold('user_id, day', 'user_timeslots')}"""

BIDS_AFTER = f"""{BID_REQUESTS}, last_put AS (
  SELECT * FROM taken WHERE op = 'put'
  QUALIFY row_number() OVER (PARTITION BY user_id, title_id ORDER BY seq DESC) = 1),
last_change AS (
  SELECT * FROM taken
  QUALIFY row_number() OVER (PARTITION BY user_id, title_id ORDER BY seq DESC) = 1),
keys AS (SELECT user_id, title_id FROM user_bids UNION SELECT user_id, title_id FROM taken)
SELECT user_id, title_id, coalesce(c.status, b.status) AS status,
  CASE WHEN p.seq IS NOT NULL THEN p.num_tickets ELSE b.num_tickets END AS num_tickets,
  CAST(CASE WHEN p.seq IS NOT NULL THEN p.ticket_bid ELSE b.ticket_bid END AS DOUBLE) AS ticket_bid,
  {_iso('CASE WHEN p.seq IS NOT NULL THEN p.valid_from ELSE b.valid_from END')} AS "from",
  {_iso('CASE WHEN p.seq IS NOT NULL THEN p.valid_to ELSE b.valid_to END')} AS "to",
  CASE WHEN p.seq IS NOT NULL THEN p.is_preapp ELSE b.is_preapp END AS is_preapp
FROM keys LEFT JOIN user_bids b USING (user_id, title_id)
LEFT JOIN last_put p USING (user_id, title_id) LEFT JOIN last_change c USING (user_id, title_id)"""

STREAM_BIDS = f"""WITH {REQUESTS}, {CHANGES}
SELECT user_id || '_' || title_id AS user_id_title_id, CAST(user_id AS VARCHAR) AS user_id,
  title_id, status, CAST(CASE WHEN k % 3 <> 0 THEN k % 7 + 1 ELSE 1 END AS INTEGER) AS num_tickets,
  CAST(CAST(value AS DECIMAL(10, 2)) AS DOUBLE) AS ticket_bid, {_iso('day')} AS "from",
  {_iso('day + 7')} AS "to", k % 4 <> 0 AS is_preapp,
  user_id || '_' || status AS user_id_status
FROM changes
QUALIFY row_number() OVER (PARTITION BY user_id, title_id ORDER BY seq DESC) = 1"""

SLOTS_AFTER = f"""{SLOT_REQUESTS}, last_put AS (
  SELECT * FROM taken WHERE op = 'put'
  QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY seq DESC) = 1),
last_change AS (
  SELECT * FROM taken QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY seq DESC) = 1),
keys AS (SELECT user_id, day FROM user_timeslots UNION SELECT user_id, day FROM taken)
SELECT user_id, {_iso('day')} AS day, coalesce(c.status, s.status) AS status,
  CASE WHEN p.seq IS NOT NULL THEN p.is_preapp ELSE s.is_preapp END AS is_preapp
FROM keys LEFT JOIN user_timeslots s USING (user_id, day)
LEFT JOIN last_put p USING (user_id, day) LEFT JOIN last_change c USING (user_id, day)"""

REJECT_COLUMNS = f"""seq, user_id, {_iso('day')} AS day, title_id,
  CASE WHEN title_id NOT IN (SELECT title_id FROM titles) THEN 'no such show'
       WHEN bid_status IS NULL THEN 'no such bid'
       WHEN bid_status <> 'AVAILABLE' THEN 'bid not available'
       WHEN NOT won THEN 'bid taken'
       WHEN slot_status IS NULL THEN 'no such timeslot'
       WHEN slot_status <> 'AVAILABLE' THEN 'timeslot not available'
       ELSE 'timeslot taken' END AS reason"""

PURCHASES = f"""{SHOW_EVENTS}, {REQUESTS}, r AS (
  SELECT seq, user_id, title_id, day, k % 4 + 1 AS num_tickets,
         sum(k % 4 + 1) OVER (PARTITION BY title_id, day ORDER BY seq) AS upto
  FROM requests WHERE event_type = 'click'),
judged AS (
  SELECT r.seq, r.user_id, r.title_id, r.day, r.num_tickets,
    CASE WHEN s.title_id IS NULL THEN 'no such event'
         WHEN upto > num_tickets_available THEN 'not enough tickets' END AS reason
  FROM r LEFT JOIN show_event s ON s.title_id = r.title_id AND s.day = r.day)"""

SWEEP = f"""WITH RECURSIVE {LINES}, {INTEREST}, {FREE_DAYS}, {JOINED},
pop AS (SELECT c_custkey AS pu, c_acctbal < 0 AS p FROM customer),
start AS MATERIALIZED (SELECT p, u, d, t, bid FROM joined JOIN pop ON pu = u),
st AS (
  SELECT 0 AS step, 'A' AS kind, p, u, d, t, bid FROM start
  UNION ALL
  (WITH act AS (SELECT * FROM st WHERE kind = 'A'),
        best AS (SELECT p AS bp, d AS bd, t AS bt FROM (
                   SELECT p, d, t, row_number() OVER (PARTITION BY p ORDER BY sum(bid) DESC, d, t) AS n
                   FROM act GROUP BY p, d, t HAVING sum(bid) > {SWEEP_MINIMUM}) WHERE n = 1),
        bu AS (SELECT u FROM act JOIN best ON p = bp AND d = bd AND t = bt)
   SELECT step + 1, CASE WHEN d = bd AND t = bt THEN 'B' ELSE 'A' END, p, act.u, d, t, bid
   FROM act JOIN best ON p = bp
   WHERE (d = bd AND t = bt) OR NOT (act.u IN (SELECT u FROM bu) AND (d = bd OR t = bt)))),
won AS (SELECT p, step, u, bid FROM st WHERE kind = 'B'),
result AS (SELECT p, count(DISTINCT step) AS groups, count(*) AS n, sum(bid) AS money,
                  count(DISTINCT u) AS users FROM won GROUP BY p),
profile AS (SELECT p, count(DISTINCT user_id) AS total_users, count(*) AS rows_in,
                   count(DISTINCT title_id) AS titles, min(total_bid) AS low, max(total_bid) AS high
            FROM interest JOIN pop ON pu = user_id GROUP BY p),
days AS (SELECT p, count(*) AS n FROM free_days JOIN pop ON pu = user_id GROUP BY p)
SELECT total_users, CAST(avg(rows_in) AS DOUBLE) AS user_interest_rows,
  CAST(avg(titles) AS DOUBLE) AS total_titles, CAST(avg(days.n) AS DOUBLE) AS user_timeslot_rows,
  CAST(avg(low) AS DOUBLE) AS min_bid, CAST(avg(high) AS DOUBLE) AS max_bid,
  CAST(1 AS DOUBLE) AS max_num_ticket, CAST({SWEEP_MINIMUM} AS DOUBLE) AS min_group_bid,
  CAST(avg(coalesce(groups, 0)) AS DOUBLE) AS result_num_group,
  CAST(avg(coalesce(result.n, 0)) AS DOUBLE) AS result_total_users,
  CAST(avg(coalesce(money, 0)) AS DOUBLE) AS result_total_money,
  CAST(avg(coalesce(users, 0)) AS DOUBLE) AS result_unique_users,
  CAST(avg(coalesce(result.n, 0)) AS DOUBLE) / total_users * 100 AS user_percent,
  CAST(avg(coalesce(users, 0)) AS DOUBLE) / total_users * 100 AS unique_user_percent
FROM profile JOIN days USING (p) LEFT JOIN result USING (p) GROUP BY total_users"""

VENUE_GREEDY = f"""WITH RECURSIVE {LINES}, {VENUES}, st AS (
  SELECT 0 AS step, 'A' AS kind, u, ts, t, v, bid FROM venue_bids
  UNION ALL
  (WITH act AS (SELECT * FROM st WHERE kind = 'A'),
        best AS (SELECT ts AS bts, t AS bt, v AS bv, sum(bid) AS s FROM act GROUP BY ts, t, v
                 HAVING sum(bid) >= {VENUE_MINIMUM} ORDER BY s DESC, bts, bt, bv LIMIT 1),
        bu AS (SELECT u FROM act JOIN best ON ts = bts AND t = bt AND v = bv)
   SELECT step + 1, CASE WHEN ts = bts AND t = bt AND v = bv THEN 'B' ELSE 'A' END,
          act.u, ts, t, v, bid
   FROM act CROSS JOIN best
   WHERE (ts = bts AND t = bt AND v = bv)
      OR NOT (act.u IN (SELECT u FROM bu) AND (ts = bts OR t = bt))))
SELECT CAST(step AS BIGINT) AS event_rank, ts AS timeslot, t AS title_id, v AS venue_id,
  CAST(sum(bid) AS BIGINT) AS bids_total, count(*) AS num_tickets
FROM st WHERE kind = 'B' GROUP BY step, ts, t, v"""

GROUPS = f"""WITH {LINES}, {INTEREST}, {FREE_DAYS}, {JOINED}
SELECT {_iso('d')} AS day, t AS title_id, CAST(sum(bid) AS BIGINT) AS bids_total,
  count(*) AS num_tickets FROM joined GROUP BY d, t"""

VENUE_GROUPS = f"""WITH {LINES}, {VENUES}
SELECT ts AS timeslot, t AS title_id, v AS venue_id, CAST(sum(bid) AS BIGINT) AS bids_total,
  count(*) AS num_tickets FROM venue_bids GROUP BY ts, t, v"""

def expansion(bids: int, slots: int, venues: int) -> str:
    return f"""WITH {TITLES}, t AS (
  SELECT title_id, row_number() OVER (ORDER BY title_id) - 1 AS n, count(*) OVER () AS c FROM titles),
v AS (
  SELECT s_suppkey AS venue_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS n,
         count(*) OVER () AS c FROM supplier),
line AS (
  SELECT c_custkey AS u, c_custkey * {bids} + i AS a, (c_custkey * {bids} + i) * {slots} + j AS b,
         ((c_custkey * {bids} + i) * {slots} + j) * {venues} + x AS e
  FROM customer, range({bids}) q(i), range({slots}) r(j), range({venues}) s(x))
SELECT u AS user_id, title_id,
  strftime(DATE '2024-01-01' + CAST(b % 14 AS INTEGER) + to_hours(b % 7 * 2), '%Y-%m-%d %H:00') AS timeslot,
  venue_id, (10 + u % 6) * (1 + u % 4) AS total_bid
FROM line JOIN t ON a % t.c = t.n JOIN v ON e % v.c = v.n"""

EXPANSION = expansion(2, 2, 5)

BID_REQUESTS_AT = f"""WITH RECURSIVE {LINES}, {USER_BIDS}, {REQUESTS}, {CHANGES},
{_machine(S.BID_TRANSITIONS)}, brand AS (
  SELECT DISTINCT p_brand AS title_id, {_from('p_brand')} AS f, {NUMBER.format('p_brand')} AS no FROM part
  WHERE {NUMBER.format('p_brand')} % 8 <> 7),
period AS (
  SELECT title_id, f AS a, f + 6 AS b FROM brand UNION ALL SELECT title_id, f + 10, f + 20 FROM brand
  UNION ALL SELECT title_id, f + 4, f + 11 FROM brand WHERE no % 3 = 0),
asked AS (
  SELECT c.seq, c.op, c.user_id, c.title_id, c.status,
         CASE WHEN op = 'put' THEN
           CASE WHEN c.title_id NOT IN (SELECT title_id FROM brand) THEN 'no such title'
                WHEN NOT EXISTS (SELECT 1 FROM period p WHERE p.title_id = c.title_id AND e.ts BETWEEN p.a AND p.b)
                THEN 'title is expired' END END AS refusal
  FROM changes c JOIN events e ON e.event_id = c.seq), {_fold('user_id, title_id', 'user_bids')}"""

SLOT_REQUESTS_AT = f"""WITH RECURSIVE {USER_TIMESLOTS}, {REQUESTS}, {CHANGES},
{_machine(S.TIMESLOT_TRANSITIONS)}, dated AS (
  SELECT c.seq, op, c.user_id, status, CAST(ts AS DATE) AS today,
         CAST(ts AS DATE) + CAST(c.seq % 25 * 16 - 16 AS INTEGER) AS day
  FROM changes c JOIN events e ON e.event_id = c.seq),
asked AS (
  SELECT seq, op, user_id, day, status,
         CASE WHEN op = 'put' AND day < today THEN 'day is in the past'
              WHEN op = 'put' AND day > today + 365 THEN 'day too far off in the future' END AS refusal
  FROM dated), {_fold('user_id, day', 'user_timeslots')}"""

# All populations step by step at once: in each step the best group of each.
SIZE_SWEEP = f"""WITH RECURSIVE {TABLES}, member AS (
  SELECT u, row_number() OVER (ORDER BY u) AS n
  FROM (SELECT user_id AS u FROM interest UNION SELECT user_id FROM free_days)),
size AS (SELECT range AS z FROM range(500, 5001, 500)),
st AS (
  SELECT 0 AS step, 'A' AS kind, z, u, d, t, bid FROM joined JOIN member USING (u) JOIN size ON n <= z
  UNION ALL
  (WITH act AS (SELECT * FROM st WHERE kind = 'A'),
        best AS (SELECT z AS bz, d AS bd, t AS bt, sum(bid) AS s FROM act GROUP BY z, d, t
                 HAVING sum(bid) > {MINIMUM}
                 QUALIFY row_number() OVER (PARTITION BY z ORDER BY s DESC, bd, bt) = 1),
        bu AS (SELECT z, u FROM act JOIN best ON z = bz AND d = bd AND t = bt)
   SELECT step + 1, CASE WHEN d = bd AND t = bt THEN 'B' ELSE 'A' END, z, act.u, d, t, bid
   FROM act JOIN best ON z = bz
   WHERE (d = bd AND t = bt) OR NOT ((z, act.u) IN (SELECT (z, u) FROM bu) AND (d = bd OR t = bt)))),
booked AS MATERIALIZED (SELECT * FROM st WHERE kind = 'B')
SELECT z AS total_users,
  (SELECT count(*) FROM interest JOIN member ON u = user_id WHERE n <= z) AS user_interest_rows,
  (SELECT count(*) FROM free_days JOIN member ON u = user_id WHERE n <= z) AS user_timeslot_rows,
  (SELECT count(DISTINCT (d, t)) FROM booked b WHERE b.z = size.z) AS result_num_group,
  (SELECT CAST(coalesce(sum(bid), 0) AS BIGINT) FROM booked b WHERE b.z = size.z) AS result_total_money,
  (SELECT count(*) FROM booked b WHERE b.z = size.z) AS result_total_users,
  (SELECT count(DISTINCT u) FROM booked b WHERE b.z = size.z) AS result_unique_users
FROM size"""

SQL: dict[str, str] = {
    "available_bids": f"""WITH {LINES}
SELECT user_id, title_id, CAST(l_linenumber AS VARCHAR) AS num_tickets,
  CAST(CAST(l_quantity AS DECIMAL(10, 2)) AS VARCHAR) AS ticket_bid,
  l_linenumber * l_quantity AS total_bid
FROM lines WHERE o_orderstatus = 'O'""",
    "available_timeslots": f"""WITH {USER_TIMESLOTS}
SELECT user_id, {_iso('day')} AS day FROM user_timeslots WHERE status = 'AVAILABLE'""",
    "dedup_first_bid": f"""WITH {LINES}
SELECT user_id, title_id, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS total_bid
FROM lines QUALIFY row_number() OVER (
  PARTITION BY user_id, title_id ORDER BY l_orderkey, l_linenumber, l_quantity) = 1""",
    "interest_by_slot": f"""WITH {LINES}, {INTEREST}, {FREE_DAYS}, {JOINED}
SELECT u AS user_id, t AS title_id, bid AS total_bid, {_iso('d')} AS day FROM joined""",
    "unmatched_interest": f"""WITH {LINES}, {USER_BIDS}, {FREE_DAYS}
SELECT user_id, title_id, total_bid FROM user_bids
WHERE user_id NOT IN (SELECT user_id FROM free_days)""",
    "group_totals": GROUPS,
    "ranked_groups": GROUPS + " ORDER BY bids_total DESC, day, title_id",
    "best_group": GROUPS
    + f" HAVING sum(bid) > {MINIMUM} ORDER BY bids_total DESC, day, title_id LIMIT 1",
    "venue_totals": VENUE_GROUPS,
    "best_show": VENUE_GROUPS
    + f" HAVING sum(bid) >= {VENUE_MINIMUM}"
    + " ORDER BY bids_total DESC, timeslot, title_id, venue_id LIMIT 1",
    "booking_events": f"""{GREEDY}
SELECT event_rank, {_iso('d')} AS day, t AS title_id, bids_total, num_tickets FROM event""",
    "booking_events_valid": f"""{GREEDY_VALID}
SELECT event_rank, {_iso('d')} AS day, t AS title_id, bids_total, num_tickets FROM event""",
    "booked_rows": f"""{GREEDY}
SELECT u AS user_id, {_iso('d')} AS day, t AS title_id, bid AS total_bid, event_rank FROM booked""",
    "canceled_rows": f"""{GREEDY}
SELECT u AS user_id, {_iso('o.d')} AS day, o.t AS title_id, bid AS total_bid, cause_rank,
  {_iso('e.d')} AS cause_day, e.t AS cause_title
FROM outcome o JOIN event e ON e.event_rank = o.cause_rank WHERE NOT own""",
    "final_status": f"""{GREEDY}
SELECT u AS user_id, {_iso('d')} AS day, t AS title_id, bid AS total_bid,
  CASE WHEN own THEN 'B' WHEN cause_rank IS NOT NULL THEN 'C' ELSE 'A' END AS status
FROM outcome""",
    "run_stats": f"""{GREEDY}
SELECT count(DISTINCT event_rank) AS events_found, CAST(coalesce(sum(bid), 0) AS BIGINT) AS total_bids,
  count(*) AS rows_booked, count(DISTINCT u) AS unique_users FROM booked""",
    "venue_booking_events": VENUE_GREEDY,
    "event_messages": f"""{GREEDY}
SELECT t AS title_id, {_iso('d')} AS day, num_tickets, CAST(bids_total AS DOUBLE) AS bids_total
FROM event""",
    "reservation_messages": f"""{GREEDY}
SELECT CAST(u AS VARCHAR) AS user_id, {_iso('d')} AS day, t AS title_id FROM booked""",
    "show_events": f"{SHOW_EVENTS} SELECT {SHOW_EVENT_COLUMNS} FROM show_event",
    "bookings": f"{APPLIED} SELECT {BOOKING_COLUMNS} FROM booking",
    "bids_after_apply": f"""{APPLIED}
SELECT b.user_id, b.title_id, CASE WHEN j.seq IS NOT NULL THEN 'BOOKED' ELSE b.status END AS status,
  b.user_id || '_' || CASE WHEN j.seq IS NOT NULL THEN 'BOOKED' ELSE b.status END AS user_id_status,
  coalesce(NOT placed, false) AS orphan
FROM user_bids b LEFT JOIN (SELECT * FROM judged WHERE won) j
  ON j.user_id = b.user_id AND j.title_id = b.title_id""",
    "slots_after_apply": f"""{APPLIED}
SELECT s.user_id, {_iso('s.day')} AS day,
  CASE WHEN j.seq IS NOT NULL THEN 'BOOKED' ELSE s.status END AS status
FROM user_timeslots s LEFT JOIN (SELECT * FROM judged WHERE placed) j
  ON j.user_id = s.user_id AND j.day = s.day""",
    "rejected_messages": f"{APPLIED} SELECT {REJECT_COLUMNS} FROM judged WHERE NOT placed",
    "bid_requests_result": f"""{BID_REQUESTS}
SELECT seq, user_id, title_id, ok, message, {RESULT} FROM answered""",
    "timeslot_requests_result": f"""{SLOT_REQUESTS}
SELECT seq, user_id, {_iso('day')} AS day, ok, message, {RESULT} FROM answered""",
    "bids_after_requests": BIDS_AFTER,
    "timeslots_after_requests": SLOTS_AFTER,
    "preferences": f"""WITH {REQUESTS}, stated AS (
  SELECT user_id, k % 2 <> 0 AS is_preapp, CASE WHEN k % 3 = 0 THEN 'OR' ELSE 'ANY' END AS or_or_any
  FROM requests WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
SELECT c_custkey AS user_id, is_preapp, or_or_any,
  CASE WHEN or_or_any IS NULL THEN 'no such user' END AS error
FROM customer LEFT JOIN stated ON user_id = c_custkey""",
    "contract_rejects": f"""WITH {REQUESTS}, r AS (
  SELECT seq, 'member' || user_id AS user_id, k * 6 AS num_tickets,
         CAST(value AS DECIMAL(10, 2)) AS ticket_bid FROM requests),
judged AS (
  SELECT seq, user_id, num_tickets, CAST(ticket_bid AS DOUBLE) AS ticket_bid,
    CASE WHEN NOT regexp_matches(user_id, '^[a-z0-9]{{8,64}}$') THEN 'username'
         WHEN ticket_bid NOT BETWEEN 5 AND 1000 THEN 'ticket_bid'
         WHEN num_tickets NOT BETWEEN 1 AND 500 THEN 'num_tickets' END AS reason
  FROM r)
SELECT * FROM judged WHERE reason IS NOT NULL""",
    "user_active_bids": f"""WITH {LINES}, {USER_BIDS}
SELECT user_id, user_id_title_id, user_id || '_' || status AS user_id_status, title_id, num_tickets,
  ticket_bid, {_iso('valid_from')} AS "from", status, is_preapp
FROM user_bids WHERE status = 'AVAILABLE'""",
    "active_bids_page": f"""WITH {LINES}, {USER_BIDS}
SELECT user_id, user_id_title_id, user_id || '_' || status AS user_id_status, title_id, num_tickets,
  ticket_bid, {_iso('valid_from')} AS "from", status, is_preapp
FROM user_bids WHERE status = 'AVAILABLE' AND user_id_title_id > '5'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY user_id_title_id) <= 2""",
    "user_timeslots": f"""WITH {USER_TIMESLOTS}
SELECT user_id || '_' || {_iso('day')} AS user_id_day, user_id, {_iso('day')} AS day, status, is_preapp
FROM user_timeslots WHERE status <> 'EXPIRED'""",
    "current_titles": f"""WITH {TITLES}
SELECT title_id, expired, title_name FROM titles WHERE expired = 0""",
    "titles_in_range": f"""WITH {TITLES}
SELECT title_id, expired, title_name FROM titles
WHERE expired = 0 AND valid_from <= DATE '2024-01-20' AND valid_to >= DATE '2024-01-16'""",
    "events_in_range": f"""{SHOW_EVENTS}
SELECT title_id_day, status, title_name, {_iso('day')} AS day, ticket_price, num_tickets_available
FROM show_event WHERE show_event.day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'""",
    "available_events": f"""{SHOW_EVENTS}
SELECT title_id_day, status, title_name, {_iso('day')} AS day, ticket_price, num_tickets_available
FROM show_event WHERE status = 'AVAILABLE'""",
    "bookings_of_users": f"""{APPLIED}
SELECT {BOOKING_COLUMNS} FROM booking WHERE booking.day >= DATE '2024-01-05'
AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "status_changes": f"""WITH {USER_TIMESLOTS}, {REQUESTS}
SELECT r.user_id, {_iso('r.day')} AS day, s.status AS old_status,
  coalesce(s.status = 'AVAILABLE', false) AS changed,
  CASE WHEN s.status = 'AVAILABLE' THEN 'BOOKED' ELSE s.status END AS status
FROM (SELECT DISTINCT user_id, day FROM requests WHERE event_type = 'purchase') r
LEFT JOIN user_timeslots s ON s.user_id = r.user_id AND s.day = r.day""",
    "canceled_output": f"""{GREEDY}
SELECT u AS user_id, {_iso('d')} AS day, t AS title_id, bid AS total_bid, cause_rank
FROM outcome WHERE cause_rank IS NOT NULL AND NOT own""",
    "cleared_table": f"""WITH {USER_TIMESLOTS}
SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM user_timeslots""",
    "bookings_of_user": f"""{APPLIED}
SELECT {BOOKING_COLUMNS} FROM booking
WHERE booking.day BETWEEN DATE '2024-01-02' AND DATE '2024-01-10' AND status = 'BOOKED'""",
    "ticket_purchases": f"""{PURCHASES}
SELECT seq, user_id, title_id, {_iso('day')} AS day, num_tickets, reason, reason IS NULL AS granted
FROM judged""",
    "tickets_sold": f"""{PURCHASES}
SELECT seq, user_id || '_' || title_id || '_' || {_iso('day')} AS user_id_event_id, user_id, title_id,
  {_iso('day')} AS day, num_tickets, 'BOOKED' AS status FROM judged WHERE reason IS NULL""",
    "events_after_purchases": f"""{PURCHASES}, sale AS (
  SELECT title_id AS t, day AS d, sum(num_tickets) AS sold FROM judged WHERE reason IS NULL
  GROUP BY ALL),
after_sale AS (
  SELECT s.* REPLACE (CAST(num_tickets_available - coalesce(sold, 0) AS BIGINT) AS num_tickets_available,
                      CASE WHEN sold = num_tickets_available THEN 'FULL' ELSE status END AS status)
  FROM show_event s LEFT JOIN sale ON t = title_id AND d = day)
SELECT {SHOW_EVENT_COLUMNS} FROM after_sale""",
    "canceled_bookings": f"""{APPLIED}
SELECT user_id_event_id, user_id, title_id, {_iso('day')} AS day,
  CASE WHEN EXISTS (SELECT 1 FROM requests r WHERE r.event_type = 'error'
                    AND r.user_id = booking.user_id AND r.title_id = booking.title_id
                    AND r.day = booking.day) THEN 'CANCELED' ELSE status END AS status
FROM booking""",
    "input_profile": f"""WITH {LINES}, {INTEREST}, {FREE_DAYS}
SELECT count(DISTINCT user_id) AS total_users, count(DISTINCT title_id) AS total_titles,
  count(*) AS user_interest_rows, min(total_bid) AS min_bid, max(total_bid) AS max_bid,
  (SELECT count(*) FROM free_days) AS user_timeslot_rows FROM interest""",
    "experiment_summary": SWEEP,
    "bid_expansion": EXPANSION,
    "validity_split": f"""SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS title_id,
  p_name AS title_name,
  CASE WHEN half THEN '2024-01-03' ELSE '2023-12-19' END AS "from",
  CASE WHEN half THEN '2024-01-17' ELSE '2024-01-02' END AS "to",
  CASE WHEN half THEN 0 ELSE 1 END AS expired
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) * 2 - 2 < count(*) OVER () AS half FROM part)""",
    "text_roundtrip": f"""WITH {LINES}, {VENUES}
SELECT CAST(u AS VARCHAR) AS user_id, t AS title_id, ts AS timeslot, v AS venue_id, bid AS total_bid
FROM venue_bids""",
    "id_list": "SELECT c_name AS id FROM customer",
    "interest_csv": f"""WITH {LINES}, {INTEREST}
SELECT CAST(user_id AS VARCHAR) AS user_id, title_id, total_bid FROM interest""",
    "timeslot_csv": f"""WITH {FREE_DAYS}
SELECT CAST(user_id AS VARCHAR) AS user_id, {_iso('day')} AS day FROM free_days""",
    "encoded_records": f"""WITH {REQUESTS}, {CHANGES}
SELECT seq, CAST(user_id AS VARCHAR) AS user_id, title_id, status,
  CAST(CASE WHEN k % 3 <> 0 THEN k % 7 + 1 ELSE 1 END AS INTEGER) AS num_tickets,
  CAST(CAST(value AS DECIMAL(10, 2)) AS DOUBLE) AS ticket_bid, {_iso('day')} AS "from",
  {_iso('day + 7')} AS "to", k % 4 <> 0 AS is_preapp FROM changes""",
    "stream_bid_upsert": STREAM_BIDS,
    "stream_events": f"{SHOW_EVENTS} SELECT {SHOW_EVENT_COLUMNS} FROM show_event",
    "stream_reservations": f"{APPLIED} SELECT {BOOKING_COLUMNS} FROM booking",
    "stream_transitions": BIDS_AFTER,
    "stream_timeslots": SLOTS_AFTER,
    "stream_event_rejects": f"""{GREEDY}, {TITLES}
SELECT event_rank AS seq, t AS title_id, {_iso('d')} AS day, 'no such title' AS reason
FROM event JOIN titles ON t = title_id WHERE expired = 1""",
    "stream_rejects": f"""{APPLIED}
SELECT * REPLACE (regexp_replace(reason, ' (taken|not available)$', ' not free') AS reason)
FROM (SELECT {REJECT_COLUMNS} FROM judged WHERE NOT placed)""",
    "rebooked_events": f"""{GREEDY}
SELECT event_rank, {_iso('d')} AS day, t AS title_id, bids_total, num_tickets FROM event""",
    "stream_group_totals": f"""WITH {CHANGED}
SELECT {_iso('d')} AS day, t AS title_id, CAST(sum(bid) AS BIGINT) AS bids_total, count(*) AS num_tickets
FROM joined GROUP BY d, t""",
    "rebooked_after_changes": f"""{GREEDY_CHANGED}
SELECT event_rank, {_iso('d')} AS day, t AS title_id, bids_total, num_tickets FROM event""",
    "rebooked_statuses": f"""{GREEDY_CHANGED}
SELECT u AS user_id, {_iso('d')} AS day, t AS title_id, CAST(bid AS BIGINT) AS total_bid,
  CASE WHEN own THEN 'B' WHEN cause_rank IS NOT NULL THEN 'C' ELSE 'A' END AS status FROM outcome""",
    "bid_requests_at_their_time": f"""{BID_REQUESTS_AT}
SELECT seq, user_id, title_id, ok, message, {RESULT} FROM answered""",
    "timeslot_requests_at_their_time": f"""{SLOT_REQUESTS_AT}
SELECT seq, user_id, {_iso('day')} AS day, ok, message, {RESULT} FROM answered""",
    "size_sweep": SIZE_SWEEP,
    "sized_expansion": expansion(5, 2, 1),
    "numbered_files": f"""WITH {LINES}, {VENUES}, line AS (
  SELECT lpad(CAST(u AS VARCHAR), 12, '0') || ' ' || t || ' ' || ts || ' ' || v || ' ' || bid AS value
  FROM venue_bids),
placed AS (SELECT value, (row_number() OVER (ORDER BY value) - 1) // 10000 AS file_no FROM line)
SELECT file_no, count(*) AS lines, min(value) AS first_line, max(value) AS last_line,
  count(*) AS whole_lines FROM placed GROUP BY file_no""",
    "users_over_runs": f"""WITH {LINES}, {INTEREST}, {FREE_DAYS}, run_user AS (
  SELECT DISTINCT {_iso('day')} AS run, user_id FROM free_days JOIN interest USING (user_id)),
runs AS (SELECT DISTINCT run FROM run_user)
SELECT a.run, b.run AS other, count(DISTINCT user_id) AS users, true AS within_three_percent
FROM runs a JOIN runs b ON a.run <= b.run JOIN run_user u ON u.run = a.run OR u.run = b.run
GROUP BY a.run, b.run""",
    "indexed_active_bids": f"""{APPLIED}
SELECT b.user_id, user_id_title_id, b.user_id || '_AVAILABLE' AS user_id_status, b.title_id, num_tickets,
  ticket_bid, {_iso('valid_from')} AS "from", b.status, is_preapp
FROM user_bids b LEFT JOIN (SELECT * FROM judged WHERE won) j
  ON j.user_id = b.user_id AND j.title_id = b.title_id
WHERE b.status = 'AVAILABLE' AND j.seq IS NULL
  AND b.user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""",
    "indexed_timeslots": f"""{APPLIED}
SELECT s.user_id || '_' || {_iso('s.day')} AS user_id_day, s.user_id, {_iso('s.day')} AS day,
  CASE WHEN j.seq IS NOT NULL THEN 'BOOKED' ELSE s.status END AS status, is_preapp
FROM user_timeslots s LEFT JOIN (SELECT * FROM judged WHERE placed) j
  ON j.user_id = s.user_id AND j.day = s.day
WHERE (j.seq IS NOT NULL OR s.status <> 'EXPIRED')
  AND s.user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""",
    "indexed_events": f"""{SHOW_EVENTS}
SELECT title_id_day, status, title_name, {_iso('day')} AS day, ticket_price, num_tickets_available
FROM show_event WHERE status IN ('AVAILABLE', 'FULL')""",
}
