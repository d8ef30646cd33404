"""Parameters of the catalog's queries, shared by the Spark and SQL forms."""

UNIFORM = 5
GAUSS = (5, 1.0)
BILATERAL = (5, 2.0, 30.0)
MEDIAN = 3
NLM = (20.0, 3, 5)  # h, patch, search
NLM_A = 1.0
CLAHE = (2.0, 8, 8)  # clip, tiles across, tiles down
CANNY = (50.0, 150.0)
CANNY_EVALUATED = (60.0, 180.0)
SHARES = (20, 25, 40)
SWEEP = 100
