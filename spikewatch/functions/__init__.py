from .exprs import (add_fixed_text, fixed_text, fixed_text_sql, metric_units, metric_units_sql, money_text,
                    point_class_sql, point_color_sql, point_label_sql, rule_names, rule_names_sql,
                    series_name, slice_label, slice_label_sql, underline_sql, units_to_value_sql)

__all__ = ["add_fixed_text", "fixed_text", "fixed_text_sql", "metric_units", "metric_units_sql", "money_text",
           "point_class_sql", "point_color_sql", "point_label_sql", "rule_names", "rule_names_sql",
           "series_name", "slice_label", "slice_label_sql", "underline_sql", "units_to_value_sql"]
