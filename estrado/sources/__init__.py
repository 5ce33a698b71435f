from estrado.sources.fallos import first_delivery, iter_rulings, read_table

__all__ = ["first_delivery", "iter_rulings", "read_table"]
