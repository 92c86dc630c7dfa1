"""Schemas of the stored tables and messages, and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Status names, transition outcomes, limits and formats that
# results are compared on.
AVAILABLE = "AVAILABLE"
CANCELED_BY_USER = "CANCELED_BY_USER"
BOOKED = "BOOKED"
CANCELED_OTHER_TIMESLOT_BOOKED = "CANCELED_OTHER_TIMESLOT_BOOKED"
CANCELED_OTHER = "CANCELED_OTHER"
EXPIRED = "EXPIRED"
CANCELED = "CANCELED"
FULL = "FULL"

STATUSES = (
    AVAILABLE,
    BOOKED,
    CANCELED_BY_USER,
    CANCELED_OTHER_TIMESLOT_BOOKED,
    CANCELED_OTHER,
    EXPIRED,
)

SERVICE_MINIMUM = 20
SWEEP_MINIMUM = 300
VENUE_MINIMUM = 15
RERUN_SECONDS = 300
EVENT_CAPACITY = 200
LINES_PER_FILE = 10000
POLL_SIZE = 10
DAYS_AHEAD = 365
USER_ZONE = "Asia/Jerusalem"
TICKET_BID_RANGE = (5, 1000)
NUM_TICKETS_RANGE = (1, 500)
USERNAME_PATTERN = "^[a-z0-9]{8,64}$"
SLASH_DAY = "yyyy/MM/dd"
ISO_DAY = "yyyy-MM-dd"
HOUR = "yyyy-MM-dd HH:00"

# (status before, requested status, accepted, message)
BID_TRANSITIONS = (
    (None, AVAILABLE, True, "Bid Updated"),
    (None, CANCELED_BY_USER, False, "Bid Does Not Exists"),
    (AVAILABLE, AVAILABLE, True, "Bid Changed"),
    (AVAILABLE, CANCELED_BY_USER, True, "Bid Canceled"),
    (CANCELED_BY_USER, AVAILABLE, True, "Bid Updated"),
    (CANCELED_BY_USER, CANCELED_BY_USER, False, "Bid already Canceled"),
    (BOOKED, AVAILABLE, False, "Bid already Booked"),
    (BOOKED, CANCELED_BY_USER, False, "Bid already Booked"),
    (CANCELED_OTHER, AVAILABLE, False, "Bid already canceled by system"),
    (CANCELED_OTHER, CANCELED_BY_USER, False, "Bid already Canceled by system"),
    (
        CANCELED_OTHER_TIMESLOT_BOOKED,
        AVAILABLE,
        True,
        "Bid updated but check if time-slots are available",
    ),
    (
        CANCELED_OTHER_TIMESLOT_BOOKED,
        CANCELED_BY_USER,
        True,
        "Bid canceled (note there appears to be no  time-slots available anyway",
    ),
    (EXPIRED, AVAILABLE, True, "Bid Updated with new dates"),
    (EXPIRED, CANCELED_BY_USER, False, "Bid Already Expired and Canceled"),
)

TIMESLOT_TRANSITIONS = (
    (None, AVAILABLE, True, "Timeslot Added"),
    (None, CANCELED_BY_USER, False, "Timeslot Does Not Exists"),
    (AVAILABLE, AVAILABLE, True, "Timeslot Changed"),
    (AVAILABLE, CANCELED_BY_USER, True, "Timeslot Canceled"),
    (CANCELED_BY_USER, AVAILABLE, True, "Timeslot Updated"),
    (CANCELED_BY_USER, CANCELED_BY_USER, False, "Timeslot already Canceled"),
    (BOOKED, AVAILABLE, False, "Timeslot already Booked"),
    (BOOKED, CANCELED_BY_USER, False, "Timeslot already Booked"),
    (CANCELED_OTHER, AVAILABLE, False, "Timeslot already canceled by system"),
    (CANCELED_OTHER, CANCELED_BY_USER, False, "Timeslot already Canceled by system"),
)

NO_SUCH_TITLE = "no such title"
NO_SUCH_SHOW = "no such show"
NO_SUCH_BID = "no such bid"
NO_SUCH_USER = "no such user"
TITLE_EXPIRED = "title is expired"
DAY_IN_PAST = "day is in the past"
DAY_TOO_FAR = "day too far off in the future"
BID_STATUS_RULE = "status must be AVAILABLE or CANCELED_BY_USER"
TIMESLOT_STATUS_RULE = "timeslot status can only be AVAILABLE"
# End of the fixed values.

UNDEFINED_TRANSITION = "undefined transition"
INCOMPLETE_REQUEST = "incomplete request"
UNKNOWN_OPERATION = "unknown operation"
INCOMPLETE_BID = "incomplete bid"
NEGATIVE_BID = "negative bid"
INVALID_MESSAGE = "invalid message"

TITLES = T.StructType(
    [
        T.StructField("title_id", T.StringType()),
        T.StructField("title_name", T.StringType()),
        T.StructField("from", T.DateType()),
        T.StructField("to", T.DateType()),
        T.StructField("expired", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("tickets_available", T.IntegerType()),
    ]
)

USERS = T.StructType([T.StructField("user_id", T.StringType())])

USER_BIDS = T.StructType(
    [
        T.StructField("user_id_title_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("title_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("num_tickets", T.IntegerType()),
        T.StructField("ticket_bid", T.DecimalType(10, 2)),
        T.StructField("from", T.DateType()),
        T.StructField("to", T.DateType()),
        T.StructField("is_preapp", T.BooleanType()),
        T.StructField("user_id_status", T.StringType()),
    ]
)

USER_TIMESLOTS = T.StructType(
    [
        T.StructField("user_id_day", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_preapp", T.BooleanType()),
    ]
)

PREFERENCES = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("is_preapp", T.BooleanType()),
        T.StructField("or_or_any", T.StringType()),
    ]
)

SHOW_EVENTS = T.StructType(
    [
        T.StructField("title_id_day", T.StringType()),
        T.StructField("title_id", T.StringType()),
        T.StructField("title_name", T.StringType()),
        T.StructField("from", T.DateType()),
        T.StructField("to", T.DateType()),
        T.StructField("year", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("num_tickets_available", T.LongType()),
        T.StructField("ticket_price", T.LongType()),
    ]
)

INTEREST_CSV = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("title_id", T.StringType()),
        T.StructField("total_bid", T.LongType()),
    ]
)

TIMESLOT_CSV = T.StructType(
    [T.StructField("user_id", T.StringType()), T.StructField("day", T.StringType())]
)

EVENT_MESSAGE = T.StructType(
    [
        T.StructField("title_id", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("num_tickets", T.LongType()),
        T.StructField("bids_total", T.DecimalType(30, 6)),
    ]
)

RESERVATION_MESSAGE = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("title_id", T.StringType()),
    ]
)

BID_RECORD = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("title_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("num_tickets", T.StringType()),
        T.StructField("ticket_bid", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("is_preapp", T.BooleanType()),
    ]
)

RUN_METRICS = T.StructType(
    [
        T.StructField("test_name", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("total_duration", T.LongType()),
        T.StructField("gen_input_duration", T.DoubleType()),
        T.StructField("read_input_duration", T.DoubleType()),
        T.StructField("process_duration", T.DoubleType()),
        T.StructField("total_users", T.LongType()),
        T.StructField("user_interest_rows", T.LongType()),
        T.StructField("total_titles", T.LongType()),
        T.StructField("user_timeslot_rows", T.LongType()),
        T.StructField("min_bid", T.LongType()),
        T.StructField("max_bid", T.LongType()),
        T.StructField("max_num_ticket", T.LongType()),
        T.StructField("min_group_bid", T.LongType()),
        T.StructField("result_num_group", T.LongType()),
        T.StructField("result_total_users", T.LongType()),
        T.StructField("result_total_money", T.DoubleType()),
        T.StructField("result_unique_users", T.LongType()),
    ]
)
