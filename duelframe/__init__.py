"""duelframe: analytics over archives of two-sided contests, built on Spark DataFrames.

Vocabulary: a *contest* has two *entities* and a *division*; contests of one meeting form a
*slate*; an entity without history is a *newcomer*. A contest on day D may only see state
from days strictly before D.
"""
