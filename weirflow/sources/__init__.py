from weirflow.sources.counters import Counters
from weirflow.sources.inputs import read_direct, read_staged
from weirflow.sources.outputs import FlatOutput, GroupOutput, StagedOutput, delete_matching, recover, write_outputs

__all__ = ["Counters", "FlatOutput", "GroupOutput", "StagedOutput", "delete_matching", "read_direct", "read_staged", "recover", "write_outputs"]
