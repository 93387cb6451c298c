"""Tables, streams and sinks."""
