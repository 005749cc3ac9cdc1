"""Table operators: every function takes and returns DataFrames.

Rows of one subject may be very uneven in number, so no operator windows over raw log
rows. Raw rows are first reduced with map-side aggregation to (subject, day),
(subject, label) or (location, hour) grain; windows run only over that reduced grain,
whose size per subject is bounded by the calendar.
"""
