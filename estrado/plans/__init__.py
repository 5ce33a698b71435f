from estrado.plans.scratch import materialize, scratch_dir

__all__ = ["materialize", "scratch_dir"]
