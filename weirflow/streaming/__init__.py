from weirflow.streaming.microbatch import run_stream

__all__ = ["run_stream"]
