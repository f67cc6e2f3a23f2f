"""splitcraft: build, check and score training/evaluation sets of
question/program pairs with Spark DataFrames.

Every public function takes and returns DataFrames or Columns, so the
whole flow stays one lazy Catalyst plan until a sink runs it.
"""

__version__ = "0.1.0"
