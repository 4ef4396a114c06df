from .exprs import (clip, digit_ratio, flag, nan_to_null, null_safe_sum, safe_div,  # noqa: F401
                    strip, to_double)
from .normalize import (installment, normalise, parse_emp_length, parse_month_year,  # noqa: F401
                        parse_percent, parse_request_date, parse_term)
