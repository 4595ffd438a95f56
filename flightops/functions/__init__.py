from flightops.functions.expressions import (  # noqa: F401
    delay_minutes,
    first_nonblank,
    flag_int,
    flight_number,
    flight_type,
    in_flag,
    manufacturer,
    parse_utc_time,
    pct,
    pct_round,
    round_half_up,
    sum_flag,
)
