"""The arrays that walks of isolation share."""

import numpy as np
from roadweave.operators.connectivity import Roads


def test_roads_are_views_of_shared_arrays():
    """Nodes 10-20-30-40 in a row; closing the middle link's group leaves two parts. No worker holds
    lists or dictionaries of its own."""
    arrays = Roads.lay_out(np.array([10, 20, 30]), np.array([20, 30, 40]), np.array([-7, 5, -7]))
    roads = Roads(**arrays)
    assert all(isinstance(x, memoryview) for x in vars(roads).values())
    ended, going = roads.parts(5, [20, 30])
    # both end at once, so both are told
    assert sorted((s, sorted(part)) for s, part in ended) == [(20, [10, 20]), (30, [30, 40])] and going is None
    assert arrays["to"].dtype == np.int32 and arrays["group"].dtype.itemsize == 4
