"""What a Python worker keeps from one task to the next."""
import sys
import types

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def kept(key, make):
    """The object made for ``key``; a worker holds the one of the last key only.

    Functions that travel by value get new globals with every task, so the object is held by
    a module of the worker.
    """
    name = "barloom_worker_kept"
    store = vars(sys.modules.setdefault(name, types.ModuleType(name)))
    if store.get("key") != key:
        store["made"] = None
        store.update(key=key, made=make())
    return store["made"]
