"""Structure of the 16-digit national ID: PP KK CC DD MM YY NNNN.

DD is the birth day, plus 40 for women. Three validators exist and differ on purpose:
calendar (34 province codes, month lengths), range (province 11 to 94, no calendar) and
the one that names a reason.
"""

from pyspark.sql import Column, functions as F

from .fixed import PROVINCES, REASON_DATE, REASON_DAY, REASON_LENGTH, REASON_MONTH, REASON_PROVINCE


def _part(nik, pos: int, length: int = 2) -> Column:
    return F.substring(nik, pos, length).try_cast("int")


def is_sixteen_digits(token) -> Column:
    return F.rlike(token, F.lit(r"^\p{Nd}{16}$"))


def days_in_month(month, year) -> Column:
    """Month length with leap years; NULL for a month outside 1 to 12."""
    return F.when(
        month.between(1, 12), F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    )


def _birth_day(day) -> Column:
    return F.when(day > 40, day - 40).otherwise(day)


def _flags(token, province_ok, date_ok) -> Column:
    is16 = is_sixteen_digits(token)
    return F.struct(
        is16.alias("is16"),
        (is16 & F.coalesce(province_ok, F.lit(False))).alias("province_ok"),
        (is16 & F.coalesce(date_ok, F.lit(False))).alias("date_ok"),
    )


def checks_calendar(token) -> Column:
    """is16, province_ok, date_ok with real month lengths; years 00 to 29 are 20xx."""
    day, month, yy = _birth_day(_part(token, 7)), _part(token, 9), _part(token, 11)
    year = F.when(yy <= 29, yy + 2000).otherwise(yy + 1900)
    return _flags(
        token,
        _part(token, 1).isin(list(PROVINCES)),
        (day >= 1) & (day <= days_in_month(month, year)),
    )


def checks_range(token) -> Column:
    """is16, province_ok, date_ok by number ranges only, as the token features use them."""
    day = _part(token, 7)
    return _flags(
        token,
        _part(token, 1).between(11, 94),
        (day.between(1, 31) | day.between(41, 71)) & _part(token, 9).between(1, 12),
    )


def score(token) -> Column:
    """0 not 16 digits, 0.33 unknown province, 0.67 bad date, 1 all right."""
    c = checks_calendar(token)
    return (
        F.when(~c["is16"], 0.0)
        .when(~c["province_ok"], 0.33)
        .when(~c["date_ok"], 0.67)
        .otherwise(1.0)
    )


def decode(nik) -> Column:
    """Parts as strings, so that leading zeros stay, and the gender."""
    cut = lambda pos, n=2: F.substring(nik, pos, n)
    return F.struct(
        cut(1).alias("province_code"),
        cut(3).alias("regency_code"),
        cut(5).alias("district_code"),
        cut(7).alias("day"),
        cut(9).alias("month"),
        cut(11).alias("year"),
        cut(13, 4).alias("serial"),
        F.when(_part(nik, 7) > 40, "P").otherwise("L").alias("gender"),
    )


def province_name(code) -> Column:
    """Name of a province code by a literal map: 34 entries, no join needed."""
    names = F.create_map(*[F.lit(x) for item in PROVINCES.items() for x in item])
    return F.try_element_at(names, code)


def validate(nik) -> Column:
    """valid, reason, province, gender, birth_date; years 00 to 25 are 20xx."""
    prov, raw, month, yy = (_part(nik, p) for p in (1, 7, 9, 11))
    day = F.when(raw >= 41, raw - 40).otherwise(raw)
    year = F.when(yy < 26, yy + 2000).otherwise(yy + 1900)
    known = F.coalesce(prov.isin(list(PROVINCES)), F.lit(False))
    month_ok = F.coalesce(month.between(1, 12), F.lit(False))
    day_ok = F.coalesce(day.between(1, 31), F.lit(False))
    in_month = F.coalesce(day <= days_in_month(month, year), F.lit(False))
    is16 = is_sixteen_digits(nik)
    reason = (
        F.when(~is16, REASON_LENGTH)
        .when(~known, F.format_string(REASON_PROVINCE, prov))
        .when(~month_ok, F.format_string(REASON_MONTH, month))
        .when(~day_ok, F.format_string(REASON_DAY, day))
        .when(~in_month, F.format_string(REASON_DATE, day, month, year))
    )
    # Said directly rather than as "no reason", which the optimizer would expand.
    ok = is16 & known & month_ok & day_ok & in_month
    return F.struct(
        ok.alias("valid"),
        reason.alias("reason"),
        F.when(ok, province_name(prov)).alias("province"),
        F.when(ok, F.when(raw >= 41, "P").otherwise("L")).alias("gender"),
        F.when(ok, F.make_date(year, month, day)).alias("birth_date"),
    )
