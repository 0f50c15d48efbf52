"""File events: the debounced, last-event-wins view of them, in batch and as a stream."""
