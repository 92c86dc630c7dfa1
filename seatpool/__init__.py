"""seatpool: demand-driven group bookings on Spark.

Users bid on titles and declare free days. The package finds the (day, title)
groups worth most, books them without ever giving a user two bookings on one
day or of one title, and derives everything that follows from that: events,
reservations, cancellations, updated tables, request handling and metrics.
"""
